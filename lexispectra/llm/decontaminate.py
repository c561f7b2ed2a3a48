"""Benchmark decontamination by a prefix-filtered join, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispectra.llm.urls import LOWER, UPPER
from lexispectra.runtime import stage

WINDOW = 10
#: Tables of up to so many rows go to every task; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: What separates words: ASCII but for letters and digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _split(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def words(text: Column) -> Column:
    """Words of a text, ASCII capitals in lower case."""
    return _split(F.translate(text, UPPER, LOWER))


def _loose(text: Column) -> Column:
    """The same words, but with all letters in lower case: as many, and equal wherever those of ``words`` are."""
    return _split(_folded(text))


def _folded(text: Column) -> Column:
    """All letters in lower case; a sigma does not depend on what follows."""
    return F.replace(F.lower(text), F.lit("ς"), F.lit("σ"))


def _small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if its rows have been counted and are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """Distinct windows of the items: number, content (words joined by a space), length, and the ids of their items."""
    listed = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w"))
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1))))
    cut = listed.where(F.size("w") > 0).select("item", "w", starts.alias("at"))
    cut = cut.select("item", F.slice("w", F.col("at"), F.least(F.size("w"), F.lit(size))).alias("w"))
    same = cut.groupBy(F.array_join("w", " ").alias("content")).agg(F.first(F.size("w")).alias("length"), F.collect_set("item").alias("items"))
    return same.withColumn("window", F.monotonically_increasing_id())


def _tokens(docs: DataFrame) -> DataFrame:
    split = docs.select("key", _loose(F.col("text")).alias("w"))
    return split.select("key", F.size("w").alias("n"), F.posexplode("w").alias("pos", "word"))


def _verified(docs: DataFrame, items: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """``docs`` with n_words, n_hit and items, the sorted ids of the items found; columns ``key`` and ``text`` name id and text.

    An occurrence holds all words of a window in a row, so the necessary prefix of a
    window is one word: its rarest, by counts over all documents. Document words
    are joined with those; position and length must leave room for the window; and what
    is left is verified word by word on the whole text. Tables made from the items are
    broadcast only if they have been counted and are small.
    """
    given = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    windows = stage(item_windows(items, size=size), "windows")
    placed = windows.select("window", "length", F.posexplode(F.split(_folded(F.col("content")), " ")).alias("offset", "word"))
    vocabulary = stage(placed.select("word").distinct(), "item-words")
    counts = _tokens(given).select("word").join(_small(vocabulary), "word").groupBy("word").agg(F.count("*").alias("df"))
    counts = stage(counts, "word-counts")
    # Words that no document has come first: their windows have no occurrence.
    rare = placed.join(counts, "word", "left").groupBy("window").agg(F.min_by(F.struct("word", "offset", "length", "df"), F.struct(F.coalesce("df", F.lit(0)), "word", "offset")).alias("r"))
    prefixes = stage(rare.where(F.col("r.df").isNotNull()).select("window", "r.word", "r.offset", "r.length"), "prefixes")
    start = F.col("pos") - F.col("offset")
    candidates = _tokens(given).join(_small(prefixes), "word").where((start >= 0) & (start + F.col("length") <= F.col("n")))
    candidates = candidates.select("key", start.alias("start"), "window").distinct()
    described = candidates.join(_small(windows), "window").select("key", F.struct("start", "length", "content", "items").alias("c"))
    found = described.groupBy("key").agg(F.sort_array(F.collect_list("c")).alias("c"))
    joined = docs.join(found, docs[key].eqNullSafe(found["key"]), "left").select(*docs.columns, "c")
    whole = F.col(text).cast("string")
    # Texts without a candidate are split once, to count their words.
    split = F.when(F.col("c").isNull(), _loose(whole)).otherwise(words(whole))
    # The row number keeps Catalyst from moving the split into the functions below, where it would run for each candidate.
    counted = joined.select(*docs.columns, "c", split.alias("w"), F.monotonically_increasing_id().alias("_row"))
    fits = lambda c: F.array_join(F.slice(F.col("w"), c["start"] + 1, c["length"]), " ") == c["content"]
    occurring = F.filter(F.coalesce("c", F.array().cast(found.schema["c"].dataType)), fits)
    verified = counted.select(*docs.columns, "_row", F.size("w").cast("bigint").alias("n_words"), occurring.alias("c"))
    none = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("hit"))

    def cover(state: Column, c: Column) -> Column:
        end = c["start"] + c["length"]
        return F.struct(F.greatest(state["end"], end).alias("end"), (state["hit"] + F.greatest(F.lit(0), end - F.greatest(state["end"], c["start"]))).alias("hit"))

    listed = F.array_sort(F.array_distinct(F.flatten(F.transform("c", lambda c: c["items"]))))
    return verified.select(*docs.columns, "_row", "n_words", F.aggregate("c", none, cover, lambda s: s["hit"]).alias("n_hit"), listed.alias("items"))


def _item_table(items: DataFrame, item_col: str, item_text: str) -> DataFrame:
    return items.select(F.col(item_col).alias("item_id"), F.col(item_text).cast("string").alias("text"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 and contaminated of every row of ``docs``.

    Null texts have no words, items with a null id or without words are left out, and rows that
    repeat an id are judged by their own texts; items of the same id and text count once.
    """
    given = docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text"))
    return _verified(given, _item_table(items, item_col, item_text), "_key", "_text", size).select(
        F.col("_key").alias(id_col),
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """The rows without an occurrence of an item's window, with all their columns."""
    place = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    found = _verified(docs.toDF(*place.values()), _item_table(items, item_col, item_text), place[id_col], place[text_col], size)
    return found.where("n_hit = 0 AND _row >= 0").select(*place.values()).toDF(*docs.columns)
