"""Words to vocabulary ids, keeping the order of words in their line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispectra.operators.vocabulary import word_count
from lexispectra.runtime import stage
from lexispectra.sources.corpus import tokens

# Largest vocabulary that is sent to every executor, as estimated below.
BROADCAST_BYTES = 256 * 1024 * 1024
# Rough size of a hash-table entry next to the bytes of its word.
_ENTRY_BYTES = 64
# A word with more than 1/_HOT_SHARE of all tokens is hot, so there are at most _HOT_SHARE of them.
_HOT_SHARE = 100_000


def vocabulary_bytes(vocab: DataFrame) -> int:
    """Estimated size of the word-to-id hash table."""
    size = F.sum(F.octet_length("word") + F.lit(_ENTRY_BYTES).cast("bigint"))
    return vocab.agg(F.coalesce(size, F.lit(0)).alias("size")).first()["size"]


def encode(
    lines: DataFrame, vocab: DataFrame, carry: Sequence[str] = (), broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``line_id BIGINT``, the carried columns, ``pos INT, word STRING, id INT``.

    Words outside the vocabulary disappear. ``line_id`` identifies the line
    within this plan only. Each line lies whole and in order in one partition,
    which is what the window operators rely on: a broadcast dictionary leaves the
    words where the scan put them, and no token is ever shuffled. A dictionary
    over ``broadcast_bytes`` is joined by shuffle instead. Lines in parts bring their
    own ``line_id`` (see `sources.pieces`), which no more than one byte range shares.
    """
    carry = list(carry)
    if {"line_id", "base"} <= set(lines.columns):
        stream = tokens(lines, ["line_id", "base", *carry]).withColumn("pos", F.col("base") + F.col("pos"))
    else:
        stream = tokens(lines.withColumn("line_id", F.monotonically_increasing_id()), ["line_id", *carry])
    ids = vocab.select("word", "id")
    if vocabulary_bytes(vocab) <= broadcast_bytes:
        coded = stream.join(F.broadcast(ids), "word")
    else:
        coded = _join_by_shuffle(lines, stream, ids)
        coded = coded.repartition("line_id").sortWithinPartitions("line_id", "pos")
    return coded.select("line_id", *carry, "pos", "word", "id")


def _join_by_shuffle(lines: DataFrame, stream: DataFrame, ids: DataFrame) -> DataFrame:
    """Look words up in a dictionary of any size, safe against hot words.

    The words of this corpus are counted first. The hot ones, in the vocabulary
    or not, are few by definition and go by broadcast. Of the others none holds
    more than 1/100,000 of the tokens, so a hash shuffle on the word is even.
    Tokens that are settled by the broadcast take part in the second join under
    a key of their own that spreads them and matches nothing.
    """
    counts = stage(word_count(lines).join(ids, "word", "left"), "dictionary")
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n")).first()["n"]
    is_hot = F.col("count") > F.lit(total / _HOT_SHARE)
    hot = counts.where(is_hot).select("word", F.col("id").alias("hot_id"), F.lit(True).alias("hot"))
    rest = counts.where(~is_hot & F.col("id").isNotNull()).select(F.col("word").alias("key"), "id")
    known = stream.join(F.broadcast(hot), "word", "left").where(F.col("hot").isNull() | F.col("hot_id").isNotNull())
    # A tab cannot occur inside a word.
    own_key = F.concat_ws("\t", F.lit(""), F.col("line_id"), F.col("pos"))
    joined = known.withColumn("key", F.when(F.col("hot"), own_key).otherwise(F.col("word"))).join(rest, "key", "left")
    return joined.withColumn("id", F.coalesce("hot_id", "id")).where(F.col("id").isNotNull())


def oov_filter(lines: DataFrame, vocab: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """The words of a corpus that are in the vocabulary: the carried columns, ``pos, word``."""
    return encode(lines, vocab, carry).select(*carry, "pos", "word")
