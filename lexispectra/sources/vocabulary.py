"""Vocabulary files: one ``word count`` line per word, the id is the line number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispectra.functions.encoding import decode_text, encode_text
from lexispectra.functions.text import IGNORED, NEWLINE
from lexispectra.operators.ranking import with_global_rank

# Fixed value: what a vocabulary file that is not valid UTF-8 is taken for.
FALLBACK_ENCODING = "cp1252"


def write_vocabulary(vocab: DataFrame, path: str, encoding: str | None = None) -> None:
    """Write the words by rising id; the part files continue each other in name order."""
    line = F.concat_ws(" ", "word", F.col("count").cast("string"))
    ordered = vocab.repartitionByRange("id").sortWithinPartitions("id")
    ordered.select(encode_text(line, encoding).alias("value")).write.option("lineSep", NEWLINE).text(path)


def read_vocabulary(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """``id INT, word STRING, count BIGINT``, numbered by line over the part files in name order.

    Without ``encoding`` the text is UTF-8, or `FALLBACK_ENCODING` if any line is not valid UTF-8.
    """
    raw = spark.read.option("lineSep", NEWLINE).text(path)
    if encoding is None:
        valid = raw.agg(F.coalesce(F.every(F.is_valid_utf8("value")), F.lit(True)).alias("valid")).first()["valid"]
        encoding = None if valid else FALLBACK_ENCODING
    line = F.replace(decode_text(F.col("value"), encoding), F.lit(IGNORED), F.lit(""))
    fields = F.split(F.trim(line, F.lit(" \t")), "[ \t]+")
    parsed = raw.select(
        F.get(fields, F.lit(0)).alias("word"),
        F.get(fields, F.lit(1)).cast("bigint").alias("count"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    ).where(F.col("word") != "")
    ranked = with_global_rank(parsed, [F.col("_file"), F.col("_block"), F.col("_line")], "id")
    vocab = ranked.select("id", "word", "count")
    check_unique(vocab)
    return vocab


def check_unique(vocab: DataFrame) -> None:
    """Refuse a vocabulary that lists a word twice."""
    twice = vocab.groupBy("word").agg(F.count("*").alias("n")).where("n > 1").select("word").take(3)
    if twice:
        raise ValueError(f"the vocabulary lists words more than once: {[r['word'] for r in twice]}")
