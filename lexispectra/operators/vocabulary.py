"""Corpus to ranked vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispectra.metrics import RunMetrics
from lexispectra.operators.ranking import with_global_rank
from lexispectra.runtime import drop_staged, stage
from lexispectra.sources.corpus import words

# Fixed value: the word that later stages reserve for unknown words.
RESERVED_WORD = "<unk>"


def word_count(lines: DataFrame) -> DataFrame:
    """``word STRING, count BIGINT`` over all words; combined before the shuffle."""
    return words(lines).groupBy("word").agg(F.count("*").alias("count"))


def refuse_reserved(counts: DataFrame) -> DataFrame:
    """Fail when the corpus holds the reserved word."""
    message = F.lit(f"the corpus contains the reserved word {RESERVED_WORD}; replace it first")
    checked = F.when(F.col("word") == RESERVED_WORD, F.raise_error(message).cast("bigint"))
    return counts.withColumn("count", checked.otherwise(F.col("count")))


def rank_vocabulary(counts: DataFrame, min_count: int = 10, max_vocab: int = 0) -> DataFrame:
    """Word counts to ``id INT, word STRING, count BIGINT``; ids start at 1.

    Words are ranked by falling count, then by UTF-8 bytes. ``max_vocab`` keeps
    the most frequent words; ties at the cut are chosen by MD5, so that the
    chosen words span the alphabet and are the same in every run. Dropping rare
    words first gives the same result as dropping them last and sorts less.
    """
    kept = counts.where(F.col("count") >= min_count)
    if max_vocab > 0:
        kept = most_frequent(stage(kept, "word-counts"), max_vocab)
    return with_global_rank(kept, [F.desc("count"), F.col("word")], "id")


def most_frequent(counts: DataFrame, size: int) -> DataFrame:
    """The ``size`` words of the largest counts; ties at the cut by MD5.

    The cut comes from the histogram of counts, a small table (different counts
    cannot be more than the root of twice the tokens), so only the words at the cut are sorted.
    """
    falling = Window.orderBy(F.desc("count")).rowsBetween(Window.unboundedPreceding, -1)
    histogram = counts.groupBy("count").agg(F.count("*").alias("words"))
    steps = histogram.withColumn("above", F.coalesce(F.sum("words").over(falling), F.lit(0)))
    cut = steps.where(F.col("above") + F.col("words") > size).orderBy(F.desc("count")).first()
    if cut is None:
        return counts
    ties = counts.where(F.col("count") == cut["count"]).orderBy(F.md5(F.col("word").cast("binary")), "word")
    return counts.where(F.col("count") > cut["count"]).unionByName(ties.limit(max(0, size - cut["above"])))


def build_vocab(lines: DataFrame, min_count: int = 10, max_vocab: int = 0, metrics: RunMetrics | None = None) -> DataFrame:
    """Count, cut and rank the words of a corpus; the result is a staged table.

    With ``metrics`` the counts of all words are staged too: the ranking samples its input before it sorts it.
    """
    if min_count < 0 or max_vocab < 0:
        raise ValueError("min_count and max_vocab must not be negative")
    counts = refuse_reserved(word_count(lines))
    if metrics is None:
        return stage(rank_vocabulary(counts, min_count, max_vocab), "vocabulary")
    counts = stage(metrics.watch(counts, tokens=F.sum("count"), distinct_words=F.count("*")), "word-counts")
    ranked = rank_vocabulary(counts, min_count, max_vocab)
    vocab = stage(metrics.watch(ranked, vocabulary=F.count("*"), tokens_in_vocabulary=F.sum("count")), "vocabulary")
    drop_staged(counts)
    return vocab
