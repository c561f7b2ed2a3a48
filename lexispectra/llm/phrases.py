"""Phrase collocations by sorted count streams, as in external estimation of language models (Heafield and others 2013).

Every place of the corpus gives one window of up to LONGEST words. In prefix order, all phrases of
a window's length or less are runs of that one stream, so their counts are lengths of
runs. The counts that matter are then streamed in prefix order, where the last phrase of j words
before a phrase is its own beginning, and in suffix order, where it is its own end: left, right
and extension counts come from two passes in step, without a table of phrases.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispectra.llm.text import LOWER, Block, blocks, mix, span_hashes
from lexispectra.runtime import stage

LONGEST, LEAST, TOP = 5, 100, 2000
NO_LANGUAGE = "und"
#: Frequent words up to which they are numbered and sent to every task; beyond it a word's 64-bit hash is its number.
NUMBERED = 4_000_000
#: Bytes of text that a task counts at a time, or one text: they and not the rows of a batch bound its memory.
STEP_BYTES = 8 << 20
#: Windows of a task of the sorted stream.
TASK_WINDOWS = 2_000_000
#: White space within a piece, and what ends a piece.
IN_WORD = np.ones(256, bool)
IN_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D, *map(ord, ".,;:!?")]] = False
ENDS_PIECE = np.zeros(256, np.int64)
ENDS_PIECE[[0x0A, 0x0B, 0x0C, 0x0D, *map(ord, ".,;:!?")]] = 1
_LANGUAGE = np.uint64(0xC2B2AE3D27D4EB4F)


class PieceBlock(Block):
    @cached_property
    def in_word(self) -> np.ndarray:
        return IN_WORD[self.data]

    @cached_property
    def piece(self) -> np.ndarray:
        """Number of the piece of every word; pieces end with their document too."""
        return np.cumsum(ENDS_PIECE[self.data])[self.bounds[0]] + self.doc


def _hashes(texts: pa.Array) -> np.ndarray:
    """A hash of every string."""
    found = [np.zeros(0, np.uint64)]
    for block in blocks(texts):
        found.append(block.spans(block.offsets[:-1], block.offsets[1:]))
    return np.concatenate(found)


def _keys(words: np.ndarray, language: np.ndarray) -> np.ndarray:
    """A number for each word of a language, never 0."""
    return mix(words ^ (language * _LANGUAGE)) | np.uint64(1)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of (lang, text) in order, in batches of at most `STEP_BYTES` of text or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        row = 0
        while row < batch.num_rows:
            before = ends[row - 1] if row else 0
            last = max(row + 1, int(np.searchsorted(ends, before + STEP_BYTES, "right")))
            yield batch.slice(row, last - row)
            row = last


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[PieceBlock, np.ndarray, pa.Array]]:
    """Blocks of a batch of (lang, text), the keys of their words, and the languages of their texts."""
    spoken = _hashes(batch.column("lang"))
    for block in blocks(batch.column("text")):
        block = PieceBlock(block.rows, LOWER[block.data], block.offsets)
        if len(block.doc):
            yield block, _keys(block.words, spoken[block.rows][block.doc]), batch.column("lang").slice(block.rows.start, len(block))


def _given(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col(text_col).cast("string").alias("text"))


def _strings(block: Block, numbers: np.ndarray) -> pa.Array:
    starts, ends = (x[numbers] for x in block.bounds)
    offsets = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
    places = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], ends - starts)
    return pa.StringArray.from_buffers(len(numbers), pa.py_buffer(offsets), pa.py_buffer(block.data[places]))


def count_words(given: DataFrame) -> DataFrame:
    """lang, word, n of all words; combined by step, by task, then by a shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            keys, n, words, langs = [], [], [], []
            for block, key, lang in _pieces(batch):
                distinct, first, times = np.unique(key, return_index=True, return_counts=True)
                keys.append(distinct)
                n.append(times)
                words.append(_strings(block, first))
                langs.append(lang.take(pa.array(block.doc[first])))
            if keys:
                distinct, first, back = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
                total = np.bincount(back, np.concatenate(n)).astype(np.int64)
                first = pa.array(first)
                lang, word = (pa.concat_arrays(x).take(first) for x in (langs, words))
                yield pa.RecordBatch.from_arrays([lang, word, pa.array(total)], ["lang", "word", "n"])

    counted = given.mapInArrow(count, "lang STRING, word STRING, n BIGINT")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _with_keys(words: DataFrame) -> DataFrame:
    """lang, word, n and the key of each word."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = _keys(_hashes(batch.column("word")), _hashes(batch.column("lang")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key.view(np.int64))], [*batch.schema.names, "id"])

    return words.mapInArrow(add, "lang STRING, word STRING, n BIGINT, id BIGINT")


class Packing:
    """Windows of word numbers below 2 ** bits, in as few whole numbers of 63 bits as hold them; or one each for hashes."""

    def __init__(self, largest: int | None) -> None:
        self.bits = 64 if largest is None else max(1, largest.bit_length())
        self.each = max(1, 63 // self.bits)
        self.columns = [f"c{i}" for i in range(-(-LONGEST // self.each))]

    @property
    def schema(self) -> str:
        return ", ".join(f"{c} BIGINT" for c in self.columns)

    def pack(self, words: np.ndarray) -> list[np.ndarray]:
        """Columns from a row of LONGEST words for each window; 0 stands behind its last word."""
        if self.each == 1:
            return [np.ascontiguousarray(words[:, i]).view(np.int64) for i in range(LONGEST)]
        found = []
        for i in range(0, LONGEST, self.each):
            column = np.zeros(len(words), np.int64)
            for k in range(self.each):
                column <<= self.bits
                if i + k < LONGEST:
                    column |= words[:, i + k].astype(np.int64)
            found.append(column)
        return found

    def unpack(self, columns: list[np.ndarray]) -> np.ndarray:
        if self.each == 1:
            return np.stack(columns, 1)
        words = np.zeros((len(columns[0]), LONGEST), np.int64)
        for i in range(LONGEST):
            shift = (self.each - 1 - i % self.each) * self.bits
            words[:, i] = (columns[i // self.each] >> shift) & ((1 << self.bits) - 1)
        return words


def _starts(columns: list[np.ndarray]) -> np.ndarray:
    """Where a new row begins, in sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for column in columns:
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def windows(given: DataFrame, frequent: np.ndarray | None, packing: Packing) -> DataFrame:
    """Each distinct window of a step of a task and how often it stands there.

    A window begins at every word and goes on for LONGEST words, to the end of the piece or to the first word that is
    not ``frequent`` (sorted keys; None takes all words), since no frequent phrase goes beyond that.
    """
    shared = given.sparkSession.sparkContext.broadcast(frequent)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        for batch in _steps(batches):
            found = []
            for block, key, _ in _pieces(batch):
                if frequent is None:
                    number = key
                else:
                    at = np.minimum(np.searchsorted(frequent, key), max(len(frequent) - 1, 0))
                    number = np.where(frequent[at] == key, at + 1, 0).astype(np.uint64) if len(frequent) else np.zeros(len(key), np.uint64)
                words = np.zeros((len(number), LONGEST), np.uint64)
                goes_on = number > 0
                words[:, 0] = number
                for k in range(1, LONGEST):
                    goes_on = goes_on[:-1] & (number[k:] > 0) & (block.piece[k:] == block.piece[:-k])
                    words[: len(goes_on), k][goes_on] = number[k:][goes_on]
                found.append(packing.pack(words[words[:, 1] > 0]))
            if found:
                columns = [np.concatenate(x) for x in zip(*found)]
                order = np.lexsort(columns[::-1])
                columns = [c[order] for c in columns]
                starts = _starts(columns)
                n = np.diff(np.append(starts, len(order))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.array(c[starts]) for c in columns), pa.array(n)], [*packing.columns, "n"])

    return given.mapInArrow(cut, f"{packing.schema}, n BIGINT")


def count_phrases(stream: DataFrame, packing: Packing, least: int, partitions: int) -> DataFrame:
    """words, f of the phrases of two words and more that occur ``least`` times, from windows.

    The windows are sorted by range, so no phrase, however frequent, is a key of one task.
    Runs within a batch of the sorted stream are counted whole; the first and the last run of
    each length may go on in the next batch or task, so those go on as parts, whatever their size.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words = packing.unpack([batch.column(c).to_numpy() for c in packing.columns])
            n = batch.column("n").to_numpy()
            for k in range(2, LONGEST + 1):
                held = np.flatnonzero(words[:, k - 1] != 0)
                if not len(held):
                    continue
                own = words[held, :k]
                starts = _starts(list(own.T))
                total = np.add.reduceat(n[held], starts)
                kept = total >= least
                kept[0] = kept[-1] = True
                own = own[starts[kept]]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * k), pa.array(own.reshape(-1)))
                yield pa.RecordBatch.from_arrays([lists, pa.array(total[kept])], ["words", "n"])

    ordered = stream.repartitionByRange(partitions, *packing.columns).sortWithinPartitions(*packing.columns)
    parts = ordered.mapInArrow(runs, "words ARRAY<BIGINT>, n BIGINT")
    return parts.groupBy("words").agg(F.sum("n").alias("f")).where(F.col("f") >= least)


def _in_step(phrases: DataFrame, words: Column, name: str) -> DataFrame:
    """Adds f of the beginnings of 2 to LONGEST - 1 words of the phrases, as ``words`` has them.

    In the order of ``words`` the last phrase of j words at or before a phrase is its beginning: every beginning
    of a frequent phrase is frequent, and sorts directly before all that it begins.
    """
    order = Window.partitionBy(words[0], words[1]).orderBy(words).rowsBetween(Window.unboundedPreceding, 0)
    size = F.size("words")
    found = {f"{name}{j}": F.last(F.when(size == j, F.col("f")), ignorenulls=True).over(order) for j in range(2, LONGEST)}
    return phrases.withColumns({k: F.when(size > int(k[-1]), c) for k, c in found.items()})


def _scored(phrases: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """lang, n, and per phrase the counts of all its beginnings (l1 to l4) and ends (r1 to r4)."""
    first = vocabulary.select(F.col("id").alias("_first"), "lang", F.col("n").alias("l1"), F.col("all").alias("n"))
    last = vocabulary.select(F.col("id").alias("_last"), F.col("n").alias("r1"))
    own = phrases.join(first.hint("merge"), F.col("words")[0] == F.col("_first")).drop("_first")
    own = own.join(last.hint("merge"), F.element_at("words", -1) == F.col("_last")).drop("_last")
    return _in_step(_in_step(own, F.col("words"), "l"), F.reverse("words"), "r")


def _least_cut() -> Column:
    """(score, cut, l, r) of the cut with the smallest score, the first of equal ones; in whole numbers of 38 digits."""
    size = F.size("words")
    wide = lambda c: c.cast("decimal(38,0)")
    cuts = []
    for k in range(1, LONGEST):
        left = F.col(f"l{k}")
        right = F.coalesce(*[F.when(size - k == j, F.col(f"r{j}")) for j in range(1, LONGEST)])
        score = F.call_function("div", (wide(F.col("f")) * F.lit(1000) * wide(F.col("n"))).cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(38,0)"))
        cuts.append(F.when(size > k, F.struct(score.alias("score"), F.lit(k).alias("cut"), left.alias("l"), right.alias("r"))))
    return F.array_min(F.array_compact(F.array(*cuts)))


def _covered(scored: DataFrame) -> DataFrame:
    """Phrases that never occur without one and the same word before or behind them."""
    size, f = F.size("words"), F.col("f")
    parent = lambda name: F.coalesce(*[F.when(size - 1 == j, F.col(f"{name}{j}")) for j in range(1, LONGEST)])
    shorter = size - 1
    before = scored.where((f == parent("l")) & (shorter > 1)).select(F.slice("words", F.lit(1), shorter).alias("words"))
    behind = scored.where((f == parent("r")) & (shorter > 1)).select(F.slice("words", F.lit(2), shorter).alias("words"))
    return before.unionByName(behind).distinct()


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of every language: lang, rank, phrase, a, l, r, n, score.

    Phrases of 2 to LONGEST words that occur ``least`` times; a null language is "und", null and
    empty texts have no words, repeated rows count again. A phrase that lies in a longer one of the same
    count is left out; it is enough to look at phrases one word longer, as counts between are equal too.
    Equal scores are ranked by count, then by the bytes of the phrase. Words of one
    language are told apart by 64-bit hashes where phrases are counted.
    """
    spark = docs.sparkSession
    given = _given(docs, text_col, lang_col)
    counts = stage(count_words(given), "word-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("all"))
    frequent = stage(_with_keys(counts.where(F.col("n") >= least)), "frequent-words")
    size = frequent.count()
    if size <= NUMBERED:
        keys = np.sort(frequent.select("id").toPandas()["id"].to_numpy(np.int64).view(np.uint64))
        packing, numbered = Packing(size), _numbered(frequent, keys)
    else:
        keys, packing, numbered = None, Packing(None), frequent
    vocabulary = stage(numbered.join(totals, "lang"), "vocabulary")
    tokens = counts.agg(F.sum("n")).first()[0] or 0
    partitions = max(spark.sparkContext.defaultParallelism, -(-tokens // TASK_WINDOWS))
    phrases = stage(count_phrases(windows(given, keys, packing), packing, least, partitions), "phrases")
    scored = stage(_scored(phrases, vocabulary), "scored-phrases")
    alone = scored.join(_covered(scored).hint("merge"), "words", "left_anti")
    ranked = alone.withColumn("best", _least_cut()).select("lang", "words", F.col("f").alias("a"), "n", "best.*")
    near = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    ranked = stage(ranked.withColumn("_rank", F.rank().over(near)).where(F.col("_rank") <= top).drop("_rank"), "ranked-phrases")
    spelt = ranked.select("words", F.posexplode("words").alias("pos", "id")).join(vocabulary.select("id", "word"), "id")
    spelt = spelt.groupBy("words").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("spelt"))
    named = ranked.join(spelt, "words").withColumn("phrase", F.array_join("spelt.word", " "))
    last = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return named.withColumn("rank", F.row_number().over(last).cast("bigint")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _numbered(frequent: DataFrame, keys: np.ndarray) -> DataFrame:
    """The frequent words with their place among the sorted keys, from 1, in the place of the key."""
    shared = frequent.sparkSession.sparkContext.broadcast(keys)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(shared.value, batch.column("id").to_numpy().view(np.uint64)) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(at.astype(np.int64))], batch.schema.names)

    return frequent.mapInArrow(number, "lang STRING, word STRING, n BIGINT, id BIGINT")
