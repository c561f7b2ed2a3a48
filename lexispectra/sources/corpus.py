"""Corpus scans: one row per line, split into words on demand."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispectra.functions.encoding import decode_text
from lexispectra.functions.text import NEWLINE, split_lines, split_words, truncate_word
from lexispectra.runtime import spread


def read_corpus(spark: SparkSession, path: str | list[str], encoding: str | None = None) -> DataFrame:
    """Text files as ``line STRING``, one row per newline-terminated line.

    ``lineSep`` is explicit because the reader otherwise also breaks lines at
    carriage returns. Bytes are taken as UTF-8 unless ``encoding`` names a
    single-byte character set.
    """
    scan = spread(spark.read.option("lineSep", NEWLINE).text(path))
    return scan.select(decode_text(F.col("value"), encoding).alias("line"))


def read_corpus_table(
    spark: SparkSession, path: str, text: str = "text", keys: dict[str, str] | None = None
) -> DataFrame:
    """A Parquet table with a text column as corpus lines; reads only the needed columns.

    ``keys`` maps columns to keep to their new names.
    """
    kept = [F.col(old).alias(new) for old, new in (keys or {}).items()]
    return corpus_lines(spread(spark.read.parquet(path).select(*kept, F.col(text).alias("text"))))


def corpus_lines(documents: DataFrame, text: str = "text") -> DataFrame:
    """Documents to lines: the other columns plus ``line_no INT, line STRING``."""
    others = [c for c in documents.columns if c != text]
    return documents.select(*others, F.posexplode(split_lines(F.col(text))).alias("line_no", "line"))


def tokens(lines: DataFrame, carry: Sequence[str] | None = None) -> DataFrame:
    """Lines to words: the carried columns plus ``pos INT, word STRING``, in line order.

    ``pos`` grows along the line but has gaps where separators repeat.
    """
    carry = [c for c in lines.columns if c != "line"] if carry is None else list(carry)
    return (
        lines.select(*carry, F.posexplode(split_words(F.col("line"))).alias("pos", "word"))
        .where(F.col("word") != "")
        .withColumn("word", truncate_word(F.col("word")))
    )


def words(lines: DataFrame) -> DataFrame:
    """Only the words, without positions."""
    return (
        lines.select(F.explode(split_words(F.col("line"))).alias("word"))
        .where(F.col("word") != "")
        .select(truncate_word(F.col("word")).alias("word"))
    )
