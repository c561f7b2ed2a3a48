"""Ranked lexical search: documents as impact vectors, in buckets of similar length (LEMP, Teflioudi and others 2015).

A query q and a document d are vectors with sqrt(w) and sqrt(w) * impact for the terms
of the queries, so that their product is the score. A document cannot reach a score
above |q| |d|; and, once its product over some coordinates is known, not above that plus the product of
the lengths of the rest. Documents that pass both bounds are scored in whole numbers.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispectra.llm.text import LOWER, Block, blocks
from lexispectra.runtime import stage

#: Results of each query.
TOP = 50
#: Query terms that go to every task at once; more queries take further passes.
LOT_TERMS = 1 << 20
#: Entries and documents scored together, documents of a bucket, and the longest documents, which give the first thresholds.
ENTRIES, DOCUMENTS, BUCKET, HEAD = 4_000_000, 65_536, 2_048, 16_384
#: Share of a query's squared length in the coordinates that are looked at first; the allowance for rounding in the bounds.
FOCUS, MARGIN = 0.7, 1e-9
#: Fixed value: terms are runs of digits, ASCII letters and all characters beyond ASCII.
IN_TERM = np.ones(256, bool)
IN_TERM[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False


class TermBlock(Block):
    @cached_property
    def in_word(self) -> np.ndarray:
        return IN_TERM[self.data]


def _terms(block: Block) -> TermBlock:
    return TermBlock(block.rows, LOWER[block.data], block.offsets)


def _bytes(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], pa.binary())


def query_terms(queries: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, n, terms (sorted distinct hashes) of queries with a term; rows that repeat id and text are one query."""
    kind = queries.schema[id_col].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in map(_terms, blocks(batch.column("text"))):
                own = [np.unique(block.words[a:b]) for a, b in zip(block.first, block.first[1:])]
                part = batch.slice(block.rows.start, len(block))
                yield pa.RecordBatch.from_arrays([part.column("item"), pa.array([len(x) for x in own], pa.int32()), _bytes(own)], ["item", "n", "terms"])

    given = queries.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(split, f"item {kind}, n INT, terms BINARY").where("n > 0").distinct()


@dataclass
class Queries:
    """Some queries: the distinct terms of them all, sorted, and of query q those at ``codes[starts[q]:starts[q + 1]]``."""

    items: list
    hashes: np.ndarray
    starts: np.ndarray
    codes: np.ndarray

    @classmethod
    def of(cls, rows: list) -> Queries:
        rows = sorted(rows, key=lambda r: (r["item"] is None, r["item"] if r["item"] is not None else 0, bytes(r["terms"])))
        own = [np.frombuffer(r["terms"], np.uint64) for r in rows]
        hashes = np.unique(np.concatenate([np.zeros(0, np.uint64), *own]))
        starts = np.append(0, np.cumsum([len(x) for x in own])).astype(np.int64)
        return cls([r["item"] for r in rows], hashes, starts, np.searchsorted(hashes, np.concatenate([np.zeros(0, np.uint64), *own])))

    def terms(self, q: int) -> np.ndarray:
        return self.codes[self.starts[q] : self.starts[q + 1]]


def vectors(docs: DataFrame, hashes: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, n (all terms), codes and counts of the terms of ``hashes``, for documents with at least one term."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(hashes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            for block in map(_terms, blocks(batch.column("text"))):
                at = np.minimum(np.searchsorted(wanted, block.words), len(wanted) - 1)
                held = wanted[at] == block.words
                pairs, n = np.unique(block.doc[held] * len(wanted) + at[held], return_counts=True)
                bounds = np.searchsorted(pairs, np.arange(len(block) + 1) * len(wanted))
                codes, n = (pairs % len(wanted)).astype(np.int32), n.astype(np.int32)
                cut = lambda x: _bytes([x[a:b] for a, b in zip(bounds, bounds[1:])])
                part = batch.slice(block.rows.start, len(block))
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(np.diff(block.first)), cut(codes), cut(n)], ["doc", "n", "codes", "counts"])

    given = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(count, f"doc {kind}, n BIGINT, codes BINARY, counts BINARY").where("n > 0")


def _document_frequencies(found: DataFrame, terms: int) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            total += np.bincount(_joined(batch.column("codes"), np.int32), minlength=terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["code", "df"])

    df = np.zeros(terms, np.int64)
    for row in found.select("codes").mapInArrow(count, "code INT, df BIGINT").groupBy("code").agg(F.sum("df").alias("df")).collect():
        df[row["code"]] = row["df"]
    return df


def _joined(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def impacts(counts: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 20 m) with m = 50 + (50 n N) div L, in whole numbers of any size."""
    n = n.astype(np.int64 if 50 * documents * int(n.max(initial=0)) < 1 << 63 else object)
    m = (50 + 50 * n * documents // terms).astype(np.int64)
    tf = counts.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def _measured(found: DataFrame, weights: np.ndarray, documents: int, terms: int) -> DataFrame:
    """doc, length, codes and impacts of documents that share a term with a query."""
    kind = found.schema["doc"].dataType.simpleString()
    shared = found.sparkSession.sparkContext.broadcast(weights)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            codes, counts = _joined(batch.column("codes"), np.int32), _joined(batch.column("counts"), np.int32)
            sizes = np.array([len(x) // 4 for x in batch.column("codes").to_pylist()], np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            value = impacts(counts, batch.column("n").to_numpy()[row], documents, terms)
            length = np.sqrt(np.bincount(row, weights[codes] * value.astype(np.float64) ** 2, len(sizes)))
            bounds = np.append(0, np.cumsum(sizes))
            parts = _bytes([x for x in np.split(value.astype(np.int32), bounds[1:-1])] if len(sizes) else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(length), batch.column("codes"), parts], ["doc", "length", "codes", "impacts"])

    return found.mapInArrow(measure, f"doc {kind}, length DOUBLE, codes BINARY, impacts BINARY").where("length > 0")


class _Best:
    """The best documents of one query so far: (-score, null id, id), equal scores by rising id."""

    def __init__(self, threshold: int) -> None:
        self.rows: list[tuple] = []
        self.threshold = threshold

    def add(self, ids: list, scores: np.ndarray) -> None:
        self.rows = heapq.nsmallest(TOP, [*self.rows, *((-s, i is None, i) for i, s in zip(ids, scores.tolist()))], key=_order)
        if len(self.rows) == TOP:
            self.threshold = max(self.threshold, -self.rows[-1][0])


def _order(row: tuple) -> tuple:
    return (row[0], row[1]) if row[1] else row


class _Buckets:
    """Documents by falling length, in buckets whose entries are sorted by term."""

    def __init__(self, ids: list, length: np.ndarray, sizes: np.ndarray, codes: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(-length, kind="stable")
        self.ids, self.length = ids, length[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        row = np.repeat(place, sizes)
        bucket = row // BUCKET
        by_term = np.lexsort((codes, bucket))
        self.order, self.row, self.codes, self.values = order, row[by_term], codes[by_term], values[by_term].astype(np.int64)
        self.starts = np.searchsorted(bucket[by_term], np.arange(-(-len(order) // BUCKET) + 1))

    def score(self, queries: Queries, weights: np.ndarray, plans: list, best: list[_Best]) -> None:
        lengths = np.array([p[1] for p in plans])
        for k, start in enumerate(range(0, len(self.length), BUCKET)):
            length = self.length[start : start + BUCKET]
            thresholds = np.array([b.threshold for b in best], np.float64)
            reach = lengths * length[0] * (1 + MARGIN)
            part = slice(self.starts[k], self.starts[k + 1])
            entries = self.codes[part], self.row[part] - start, self.values[part]
            for q in np.flatnonzero((reach >= thresholds) & (lengths > 0)).tolist():
                self._query(queries.terms(q), plans[q], weights, length, start, entries, best[q])

    def _query(self, terms: np.ndarray, plan: tuple, weights: np.ndarray, length: np.ndarray, start: int, entries: tuple, best: _Best) -> None:
        codes, rows, values = entries
        focus, total, rest = plan
        at = _ranges(codes, focus)
        w, v, d = weights[codes[at]], values[at].astype(np.float64), rows[at]
        known = np.bincount(d, w * v, len(length))
        left = np.sqrt(np.maximum(length**2 * (1 + MARGIN) - np.bincount(d, w * v * v, len(length)), 0.0))
        may = (known + rest * left) * (1 + MARGIN) >= max(best.threshold, 1)
        if not may.any():
            return
        at = _ranges(codes, terms)
        at = at[may[rows[at]]]
        scores = np.zeros(len(length), np.int64)
        np.add.at(scores, rows[at], weights[codes[at]] * values[at])
        enough = np.flatnonzero(scores >= max(best.threshold, 1))
        if len(enough) > TOP:
            least = np.partition(scores[enough], len(enough) - TOP)[len(enough) - TOP]
            enough = enough[scores[enough] >= least]
        if len(enough):
            best.add([self.ids[i] for i in self.order[start + enough].tolist()], scores[enough])


def _ranges(ordered: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the wanted values in an ordered array."""
    a, b = np.searchsorted(ordered, wanted), np.searchsorted(ordered, wanted, "right")
    n = b - a
    return np.arange(n.sum()) + np.repeat(a - np.cumsum(n) + n, n)


def _plans(queries: Queries, weights: np.ndarray) -> list[tuple]:
    """Of each query the coordinates looked at first (the heaviest), its length, and the length of the others."""
    plans = []
    for q in range(len(queries.items)):
        terms = queries.terms(q)
        terms = terms[np.argsort(-weights[terms], kind="stable")]
        squares = np.cumsum(weights[terms])
        total = float(squares[-1]) if len(squares) else 0.0
        cut = int(np.searchsorted(squares, FOCUS * total)) + 1
        plans.append((np.sort(terms[:cut]), math.sqrt(total), math.sqrt(max(total - float(squares[cut - 1]), 0.0)) if len(terms) else 0.0))
    return plans


def _found(measured: DataFrame, queries: Queries, weights: np.ndarray, thresholds: np.ndarray) -> DataFrame:
    """q, doc, score: the best documents of every task."""
    kind = measured.schema["doc"].dataType.simpleString()
    shared = measured.sparkSession.sparkContext.broadcast((queries, weights, thresholds))
    of_doc = measured.schema["doc"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights, thresholds = shared.value
        plans, best = _plans(queries, weights), [_Best(t) for t in thresholds.tolist()]
        held: list[pa.RecordBatch] = []
        entries = rows = 0

        def work() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            columns = {c: table.column(c).to_pylist() for c in ("codes", "impacts")}
            sizes = np.array([len(x) // 4 for x in columns["codes"]], np.int64)
            flat = [np.frombuffer(b"".join(columns[c]), np.int32) for c in ("codes", "impacts")]
            _Buckets(table.column("doc").to_pylist(), table.column("length").to_numpy(), sizes, *flat).score(queries, weights, plans, best)

        for whole in batches:
            for at in range(0, whole.num_rows, BUCKET):
                batch = whole.slice(at, BUCKET)
                held.append(batch)
                rows += batch.num_rows
                entries += sum(map(len, batch.column("codes").to_pylist())) // 4
                if entries >= ENTRIES or rows >= DOCUMENTS:
                    work()
                    held, entries, rows = [], 0, 0
        if held:
            work()
        for q, own in enumerate(best):
            if own.rows:
                docs = pa.array([r[2] for r in own.rows], pa_type)
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(own.rows), pa.int32()), docs, pa.array([-r[0] for r in own.rows], pa.int64())], ["q", "doc", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    pa_type = to_arrow_type(of_doc.dataType)
    return measured.mapInArrow(search, f"q INT, doc {kind}, score BIGINT")


def _ranked(found: DataFrame, *, by: tuple = ()) -> DataFrame:
    order = Window.partitionBy("q", *by).orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)


def search(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """The TOP documents of every query: the query's id, rank (from 1), the document's id, score; none of score 0.

    1. One pass counts in every text the terms that any query has; sums over it give the weights.
    2. The longest vectors are searched first: the score that TOP documents of them reach is a threshold for all.
    3. Every task sorts its vectors into buckets of falling length and passes over what
       cannot reach a threshold, by bucket and then by document, and keeps its best TOP; theirs are merged.

    Texts and queries that are null, empty or without terms find nothing and are not found. Equal
    scores are ranked by rising id, a null id last; rows that repeat an id are documents of their own. Queries
    that repeat id and text are one, those that repeat an id alone are ranked each for itself. Terms are
    compared by 64-bit hashes. Queries go to the tasks in lots of about LOT_TERMS terms, each a pass over the texts.
    """
    spark = docs.sparkSession
    split = stage(query_terms(queries, item_col, query_col), "queries")
    lots = max(1, math.ceil((split.agg(F.sum("n")).first()[0] or 0) / LOT_TERMS))
    kinds = [f.schema[c].dataType.simpleString() for f, c in ((queries, item_col), (docs, id_col))]
    result = spark.createDataFrame([], f"item {kinds[0]}, rank INT, doc {kinds[1]}, score BIGINT")
    for lot in range(lots):
        some = Queries.of(split.where(F.pmod(F.xxhash64("item", "terms"), F.lit(lots)) == lot).collect())
        if some.items:
            result = result.unionByName(_search_lot(docs, some, kinds[0], id_col, text_col))
    return result.select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")


def _search_lot(docs: DataFrame, queries: Queries, kind: str, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    found = stage(vectors(docs, queries.hashes, id_col, text_col), "vectors")
    sums = found.agg(F.count("*").alias("documents"), F.sum("n").alias("terms")).first()
    documents, terms = sums["documents"], sums["terms"] or 1
    df = _document_frequencies(found, len(queries.hashes))
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
    weights[df == 0] = 0  # no document has them
    measured = stage(_measured(found, weights, documents, terms), "impacts")
    share = 1 - min(1.0, HEAD / max(documents, 1))
    long = measured.agg(F.percentile_approx("length", F.lit(share), F.lit(1000)).alias("length")).first()["length"] or 0.0
    thresholds = np.zeros(len(queries.items), np.int64)
    head = _ranked(_found(measured.where(F.col("length") >= long), queries, weights, thresholds))
    for row in head.where(F.col("rank") == TOP).select("q", "score").collect():
        thresholds[row["q"]] = row["score"]
    # What no query can reach is not even read.
    lengths = np.array([p[1] for p in _plans(queries, weights)])
    least = float(np.min(thresholds[lengths > 0] / lengths[lengths > 0], initial=np.inf)) * (1 - MARGIN)
    best = _found(measured.where(F.col("length") >= least), queries, weights, thresholds)
    best = _ranked(best.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(64))), by=("salt",))
    names = spark.createDataFrame(list(enumerate(queries.items)), f"q INT, item {kind}")
    return _ranked(best.select("q", "doc", "score")).join(names, "q").select("item", "rank", "doc", "score")
