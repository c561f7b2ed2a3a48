"""Line dedup that can be undone: cuckoo filters by shard in front of an exact table of reference counts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispectra.llm.cuckoo import Cuckoo
from lexispectra.llm.text import IN_WORD, Block, blocks, groups, mix, span_hashes
from lexispectra.runtime import drop_staged, stage

#: Documents that make a line common, and the fewest bytes of a line's key.
MIN_DOCS = 10
#: Common lines of a shard, bytes of filters that go to every task at once, and common lines up to which the exact ones are broadcast.
SHARD_KEYS, FILTER_BYTES, BROADCAST_KEYS = 500_000, 64 << 20, 500_000
_SECOND = np.uint64(0xA0761D6478BD642F)
_KEY = "h1 BIGINT, h2 BIGINT"
_FILTER = "shard INT, filter BINARY"


@dataclass
class Lines:
    """The lines of a block: where each begins and ends, its document, and its key, which is 0 where it is empty."""

    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    h1: np.ndarray
    h2: np.ndarray
    filled: np.ndarray

    @classmethod
    def of(cls, block: Block) -> Lines:
        breaks = np.flatnonzero(block.data == 10)
        starts = np.sort(np.append(block.offsets[:-1], breaks + 1))
        ends = np.sort(np.append(breaks, block.offsets[1:]))
        per_doc = 1 + np.diff(np.searchsorted(breaks, block.offsets))
        # A key is the line from its first byte that is no white space to its last one.
        inside = np.flatnonzero(IN_WORD[block.data])
        bounded = np.append(inside, len(block.data))
        first = np.minimum(bounded[np.searchsorted(inside, starts)], ends)
        last = np.append(-1, inside)[np.searchsorted(inside, ends)] + 1
        filled = first < last
        lower = block.lower()
        a, b = np.where(filled, first, 0), np.where(filled, last, 0)
        h1 = np.where(filled, lower.spans(a, b), np.uint64(0))
        h2 = np.where(filled, span_hashes(mix(lower.data.astype(np.uint64) + _SECOND), a, b), np.uint64(0))
        return cls(starts, ends, np.repeat(np.arange(len(block)), per_doc), h1, h2, filled)


def _counted(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((h2, h1))
    h1, h2 = h1[order], h2[order]
    starts = np.flatnonzero(np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))) if len(h1) else np.zeros(0, np.int64)
    return h1[starts], h2[starts], np.diff(np.append(starts, len(h1)))


def count_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """h1, h2, n: in how many rows each line occurs; added up by batch, by task, then by a shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for block in blocks(batch.column(0)):
                lines = Lines.of(block)
                at = np.flatnonzero(lines.filled)
                order, new = groups(lines.doc[at], lines.h1[at])
                at = at[order[new]]
                found.append((lines.h1[at], lines.h2[at]))
            if found:
                h1, h2, n = _counted(*(np.concatenate(x) for x in zip(*found)))
                yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(n)], ["h1", "h2", "n"])

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, f"{_KEY}, n BIGINT")
    return counted.groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def _shard(h1: np.ndarray, shards: int) -> np.ndarray:
    return (h1.view(np.int64) >> 32) % shards


def _keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.ascontiguousarray(table.column(c).to_numpy()).view(np.uint64) for c in ("h1", "h2"))


def _filter_row(shard: int, filter: bytes | None) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int32()), "filter": pa.array([filter], pa.binary())})


@dataclass(frozen=True)
class LineIndex:
    """In how many documents each line occurs, and filters of the common lines.

    ``refs`` (h1, h2, docs) is exact and decides; ``filters`` (shard, filter) say without
    reading it that a line is not common. Inserting and deleting documents give a new index and leave
    the old one as it was, so that each step can be undone. What documents were inserted
    and deleted again leave no trace: the counts are those of the documents that remain.
    """

    refs: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int

    @classmethod
    def empty(cls, spark: SparkSession, min_docs: int = MIN_DOCS) -> LineIndex:
        return cls(spark.createDataFrame([], f"{_KEY}, docs BIGINT"), spark.createDataFrame([], _FILTER), 1, min_docs)

    @classmethod
    def build(cls, docs: DataFrame, text_col: str = "text", min_docs: int = MIN_DOCS) -> LineIndex:
        return cls.empty(docs.sparkSession, min_docs).insert(docs, text_col)

    def insert(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        """With all rows of ``docs`` as further documents."""
        return self._changed(count_documents(docs, text_col), 1)

    def delete(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        """Without these documents, given as they were inserted; refused if a line would count below zero."""
        return self._changed(count_documents(docs, text_col), -1)

    def discard(self) -> None:
        """Delete the tables of this index, once no other step is to start from it."""
        drop_staged(self.refs)
        drop_staged(self.filters)

    @property
    def common(self) -> DataFrame:
        return self.refs.where(F.col("docs") >= self.min_docs).select("h1", "h2")

    def _changed(self, counts: DataFrame, sign: int) -> LineIndex:
        zero = F.lit(0).cast("bigint")
        before = self.refs.select("h1", "h2", F.col("docs").alias("was"), zero.alias("change"))
        after = counts.select("h1", "h2", zero.alias("was"), (sign * F.col("n")).alias("change"))
        merged = before.unionByName(after).groupBy("h1", "h2").agg(F.sum("was").alias("was"), F.sum("change").alias("change"))
        merged = stage(merged.select("h1", "h2", "was", (F.col("was") + F.col("change")).alias("docs")).where("was <> 0 OR docs <> 0"), "line-refs")
        enough = lambda c: (F.col(c) >= self.min_docs)
        sums = merged.agg(F.min("docs").alias("least"), F.count_if(enough("docs")).alias("common")).first()
        if (sums["least"] or 0) < 0:
            drop_staged(merged)
            raise ValueError("documents are deleted that were not inserted")
        refs = merged.where("docs > 0").select("h1", "h2", "docs")
        shards = math.ceil(sums["common"] / SHARD_KEYS)
        if shards > 2 * self.shards or self.filters.isEmpty():
            # Shards of the intended size again, from the exact table.
            shards = max(1, shards)
            filters = stage(_filters_of(refs.where(enough("docs")), shards), "line-filters")
            return LineIndex(refs, filters, shards, self.min_docs)
        crossing = merged.where(enough("was") != enough("docs")).select("h1", "h2", enough("docs").alias("common"))
        updated = stage(self._updated(crossing), "line-filters")
        full = updated.where("filter IS NULL").select("shard")
        if full.isEmpty():
            return LineIndex(refs, updated, self.shards, self.min_docs)
        again = _with_shard(refs.where(enough("docs")), self.shards).join(full, "shard", "left_semi")
        filters = stage(updated.where("filter IS NOT NULL").unionByName(_filters_of(again, self.shards)), "line-filters")
        drop_staged(updated)
        return LineIndex(refs, filters, self.shards, self.min_docs)

    def _updated(self, crossing: DataFrame) -> DataFrame:
        """The filters with the lines that became common and without those that no longer are; null for one that is full."""

        def update(key: tuple, old: pa.Table, lines: pa.Table) -> pa.Table:
            found = Cuckoo.from_bytes(old.column("filter")[0].as_py()) if old.num_rows else Cuckoo.empty(lines.num_rows)
            h1, h2 = _keys(lines)
            now = lines.column("common").to_numpy()
            found.delete(h1[~now], h2[~now])
            fits = found.insert(h1[now], h2[now])
            return _filter_row(key[0].as_py(), found.to_bytes() if fits else None)

        lines = _with_shard(crossing, self.shards).groupBy("shard")
        return self.filters.groupBy("shard").cogroup(lines).applyInArrow(update, _FILTER)

    def drop(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``docs`` without their common lines, with columns _n_lines (before) and _n_dropped.

        A text without a common line stays as it is; one of common lines alone becomes
        empty; a null text has one empty line and stays null. Empty lines, and lines of
        white space alone, are never common. All columns are kept, whatever their names.

        1. Every line is looked up in the filter of its shard; what the filter does not hold is not common.
        2. The few others are checked against the exact counts, by a join.
        3. The numbers of a text's common lines come back to it by a join on hashes of id and text; rows that share both share them.

        Filters go to the tasks up to FILTER_BYTES at a time, shards beyond that in further passes.
        """
        place = {name: f"c{i}" for i, name in enumerate(docs.columns)}
        texts = place[text_col]
        keys = {"id": F.xxhash64(F.col(place[id_col])), "th": F.xxhash64(F.coalesce(F.col(texts).cast("string"), F.lit("")))}
        named = docs.toDF(*place.values()).withColumns(keys)
        plain = named.select("id", "th", F.col(texts).cast("string").alias("text"))
        sizes = sorted((r["shard"], r["bytes"]) for r in self.filters.select("shard", F.octet_length("filter").alias("bytes")).collect())
        held: list[list[int]] = [[]]
        room = FILTER_BYTES
        for shard, n in sizes:
            if held[-1] and n > room:
                held.append([])
                room = FILTER_BYTES
            held[-1].append(shard)
            room -= n
        maybe = self._candidates(plain, held[0])
        for some in held[1:]:
            maybe = maybe.unionByName(self._candidates(plain, some))
        common = self.common
        if common.count() <= BROADCAST_KEYS:
            common = F.broadcast(common)
        surely = maybe.join(common, ["h1", "h2"], "left_semi")
        listed = surely.groupBy("id", "th").agg(F.collect_set("line").alias("lines"))
        return _without_lines(named.join(listed, ["id", "th"], "left").select(*place.values(), "lines"), docs, place, texts)

    def _candidates(self, plain: DataFrame, shards: list[int]) -> DataFrame:
        """id, th, line, h1, h2 of every line that the filters of these shards hold."""
        spark, count = plain.sparkSession, self.shards
        rows = self.filters.where(F.col("shard").isin(shards)).collect() if shards else []
        shared = spark.sparkContext.broadcast({r["shard"]: bytes(r["filter"]) for r in rows})

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = {shard: Cuckoo.from_bytes(data) for shard, data in shared.value.items()}
            for batch in batches:
                for block in blocks(batch.column("text")) if filters else ():
                    lines = Lines.of(block)
                    number = np.arange(len(lines.doc)) - np.searchsorted(lines.doc, lines.doc)
                    shard = _shard(lines.h1, count)
                    found = np.zeros(len(shard), bool)
                    for k, filter in filters.items():
                        at = np.flatnonzero((shard == k) & lines.filled)
                        found[at] = filter.contains(lines.h1[at], lines.h2[at])
                    at = np.flatnonzero(found)
                    row = pa.array(lines.doc[at] + block.rows.start)
                    columns = [batch.column("id").take(row), batch.column("th").take(row), pa.array(number[at].astype(np.int32))]
                    columns += [pa.array(x[at].view(np.int64)) for x in (lines.h1, lines.h2)]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "th", "line", "h1", "h2"])

        return plain.mapInArrow(probe, f"id BIGINT, th BIGINT, line INT, {_KEY}")


def _with_shard(keys: DataFrame, shards: int) -> DataFrame:
    return keys.withColumn("shard", F.pmod(F.shiftright("h1", 32), F.lit(shards)).cast("int"))


def _filters_of(keys: DataFrame, shards: int) -> DataFrame:
    """A filter for each shard of the keys."""

    def make(key: tuple, lines: pa.Table) -> pa.Table:
        return _filter_row(key[0].as_py(), Cuckoo.of(*_keys(lines)).to_bytes())

    return _with_shard(keys.select("h1", "h2"), shards).groupBy("shard").applyInArrow(make, _FILTER)


def _without_lines(marked: DataFrame, docs: DataFrame, place: dict[str, str], texts: str) -> DataFrame:
    schema = ", ".join(f"`{place[f.name]}` {f.dataType.simpleString()}" for f in docs.schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, marks = batch.column(texts), batch.column("lines")
            kept, n_lines, n_dropped = [], [], []
            for block in blocks(text):
                own = marks.slice(block.rows.start, len(block))
                lengths = pc.fill_null(pc.list_value_length(own), 0).to_numpy()
                per_doc = 1 + np.diff(np.searchsorted(np.flatnonzero(block.data == 10), block.offsets))
                n_lines.append(per_doc)
                n_dropped.append(lengths)
                data, given = block.data.tobytes(), text.slice(block.rows.start, len(block))
                for i, n in enumerate(lengths.tolist()):
                    if n:
                        gone = set(own[i].as_py())
                        parts = data[block.offsets[i] : block.offsets[i + 1]].split(b"\n")
                        kept.append(b"\n".join(p for k, p in enumerate(parts) if k not in gone).decode())
                    else:
                        kept.append(given[i].as_py())
            if batch.num_rows:
                columns = [pa.array(kept, pa.string()) if name == texts else batch.column(name) for name in place.values()]
                counts = [pa.array(np.concatenate(x).astype(np.int64)) for x in (n_lines, n_dropped)]
                yield pa.RecordBatch.from_arrays([*columns, *counts], [*place.values(), "n_lines", "n_dropped"])

    return marked.mapInArrow(cut, f"{schema}, n_lines BIGINT, n_dropped BIGINT").toDF(*docs.columns, "_n_lines", "_n_dropped")


def without_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` without the lines that at least ``min_docs`` of them hold; see `LineIndex.drop`."""
    return LineIndex.build(docs, text_col, min_docs).drop(docs, id_col, text_col)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_lines, n_dropped and the SHA-256 of the lines that stay, joined by newlines."""
    found = without_common_lines(docs.select(id_col, text_col), id_col, text_col)
    return found.select(
        id_col, F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("kept_sha256")
    )
