"""Near-duplicate documents by min-max hashing of their word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispectra.llm.components import components
from lexispectra.llm.text import Block, blocks, groups, mix, span_hashes
from lexispectra.runtime import stage

SHINGLE, PERCENT = 5, 75
#: Hash functions; each gives a minimum and a maximum, so a signature has twice as many values.
PERMUTATIONS, ROWS = 64, 4
BANDS = 2 * PERMUTATIONS // ROWS
#: Pairs of one bucket are compared in full if this share of their signatures agrees: 0.75
#: less five standard deviations of the estimate by 128 values.
AGREE = 0.55
#: Members of a bucket or cluster that one task compares with as many others.
BUCKET_BLOCK, CLUSTER_BLOCK = 2048, 512
#: Members of buckets that are handed to a task together; most buckets have two or three.
LOT = 10_000
#: Members of clusters, by id and hash of the text, up to which all tasks get them (some 64 bytes each) to choose the texts by.
BROADCAST_NODES = 4_000_000
_random = np.random.default_rng(31)
_FACTORS = _random.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _random.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def shingle_sets(block: Block, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of every text, sorted, and where each set begins and ends.

    A text of fewer words has the sequence of them all as its one shingle, a text without words none.
    """
    block = block.lower()
    at, hashes = block.windows(size)
    doc = block.doc[at]
    short = np.flatnonzero((np.diff(block.first) > 0) & (np.diff(block.first) < size))
    doc = np.append(doc, short)
    hashes = np.append(hashes, span_hashes(block.words, block.first[short], block.first[short + 1]))
    order, new = groups(doc, hashes)
    doc, hashes = doc[order[new]], hashes[order[new]]
    return hashes, np.searchsorted(doc, np.arange(len(block) + 1))


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Minimum and maximum under each permutation, for every set that is not empty."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    found = np.empty((len(starts), 2 * PERMUTATIONS), np.uint64)
    for k in range(PERMUTATIONS if len(starts) else 0):
        permuted = hashes * _FACTORS[k] + _TERMS[k]
        permuted ^= permuted >> np.uint64(29)  # the top bits decide, and depend on all others
        found[:, 2 * k] = np.minimum.reduceat(permuted, starts)
        found[:, 2 * k + 1] = np.maximum.reduceat(permuted, starts)
    return found


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A key for each band of ROWS values, different for different bands.

    A band has minima or maxima only, each of another permutation: the minimum and the maximum
    of one permutation agree less often together than two values that are independent.
    """
    signature = np.concatenate([signature[:, ::2], signature[:, 1::2]], 1)
    keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signature), 1))
    for r in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + signature[:, r::ROWS])
    return keys


def _signed(docs: DataFrame) -> DataFrame:
    """id, th, n, set (hash of the set), bands, signature (16 bits of each value) of documents that are not empty; n = 0 for the others."""
    kind = docs.schema["id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                hashes, bounds = shingle_sets(block)
                n = np.diff(bounds)
                full = n > 0
                signature = signatures(hashes, bounds)
                keys = np.zeros((len(block), BANDS), np.int64)
                keys[full] = band_keys(signature).view(np.int64)
                short = np.zeros((len(block), 2 * PERMUTATIONS), np.uint16)
                short[full] = signature.astype(np.uint16)
                sums = [np.append(np.uint64(0), np.cumsum(x)) for x in (mix(hashes), mix(hashes ^ np.uint64(0x5BD1E995)))]
                sums = np.stack([s[bounds[1:]] - s[bounds[:-1]] for s in sums], 1)
                part = batch.slice(block.rows.start, len(block))
                columns = [
                    part.column("id"),
                    part.column("th"),
                    pa.array(n.astype(np.int64)),
                    pa.array([s.tobytes() for s in sums], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.reshape(-1))),
                    pa.array([s.tobytes() for s in short], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "th", "n", "set", "bands", "signature"])

    return docs.mapInArrow(sign, f"id {kind}, th BIGINT, n BIGINT, set BINARY, bands ARRAY<BIGINT>, signature BINARY")


class _Forest:
    """Union-find over the rows of a group, which keeps the links that joined two trees."""

    def __init__(self, n: int) -> None:
        self._up, self.links = list(range(n)), []

    def find(self, i: int) -> int:
        while self._up[i] != i:
            self._up[i] = self._up[self._up[i]]
            i = self._up[i]
        return i

    def link(self, i: int, others: np.ndarray) -> None:
        for j in others.tolist():
            a, b = self.find(i), self.find(j)
            if a != b:
                self._up[a] = b
                self.links.append((i, j))


def _block_pairs(members: DataFrame, size: str, block: int) -> DataFrame:
    """Deal each group's members to pairs of blocks: adds p <= q and mine, the member's block.

    A group of up to ``block`` members is one pair (0, 0); a larger one is cut, so no task gets more than two blocks.
    """
    n = F.ceil(F.col(size) / block).cast("int")
    mine = F.pmod(F.xxhash64("node"), n).cast("int")
    dealt = members.withColumn("_n", n).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return dealt.withColumn("p", F.least("mine", "other")).withColumn("q", F.greatest("mine", "other")).drop("_n", "other")


def _ends(frame: pd.DataFrame, links: list[tuple[int, int]]) -> pd.DataFrame:
    nodes = frame["node"].to_numpy()
    a, b = (nodes[np.array([x[k] for x in links], np.int64)] for k in (0, 1))
    return pd.DataFrame({"a": a, "b": b})


def _similar(frame: pd.DataFrame) -> pd.DataFrame:
    """Links, without cycles, between members of each bucket of a lot whose signatures agree enough.

    Blocks of a cut bucket meet each other, or themselves.
    """
    frame = frame.sort_values(["key", "p", "q"], ignore_index=True)
    signature = np.frombuffer(b"".join(frame["signature"]), np.uint16).reshape(len(frame), -1)
    mine, n, p, q = (frame[k].to_numpy() for k in ("mine", "n", "p", "q"))
    new = np.append(True, (np.diff(frame["key"]) != 0) | (np.diff(p) != 0) | (np.diff(q) != 0)) if len(frame) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    links: list[tuple[int, int]] = []
    for start, stop in zip(starts.tolist(), np.append(starts[1:], len(frame)).tolist()):
        forest = _Forest(stop - start)
        for i in range(start, stop - 1):
            rows = slice(i + 1, stop)
            near = np.minimum(n[i], n[rows]) * 100 >= PERCENT * np.maximum(n[i], n[rows])
            if p[start] != q[start]:
                near &= mine[rows] != mine[i]
            others = np.flatnonzero(near) + i + 1
            if len(others):
                agree = (signature[others] == signature[i]).sum(1)
                forest.link(i - start, others[agree >= AGREE * signature.shape[1]] - start)
        links += [(start + i, start + j) for i, j in forest.links]
    return _ends(frame, links)


def _linked(frame: pd.DataFrame) -> pd.DataFrame:
    """Links, without cycles, between members of a cluster whose full sets are similar enough."""
    m = len(frame)
    if m < 2:
        return _ends(frame, [])
    sets = [np.frombuffer(x, np.uint64) for x in frame["hashes"]]
    n = np.array([len(x) for x in sets])
    own = np.repeat(np.arange(m), n)
    distinct, number = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(number, kind="stable")
    holders, df = own[order], np.bincount(number)
    first = np.cumsum(df) - df
    ends = np.cumsum(n)
    mine, forest = frame["mine"].to_numpy(), _Forest(m)
    crossing = frame["p"].iloc[0] != frame["q"].iloc[0]
    for i in range(m):
        shared = number[ends[i] - n[i] : ends[i]]
        shared = shared[df[shared] > 1]
        size = df[shared]
        places = np.arange(size.sum()) + np.repeat(first[shared] - np.cumsum(size) + size, size)
        common = np.bincount(holders[places], minlength=m)
        linked = 100 * common >= PERCENT * (n[i] + n - common)
        linked[: i + 1] = False
        if crossing:
            linked &= mine != mine[i]
        forest.link(i, np.flatnonzero(linked))
    return _ends(frame, forest.links)


def _shingled(members: DataFrame) -> DataFrame:
    kept = [f for f in members.schema.fields if f.name != "text"]

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                hashes, bounds = shingle_sets(block)
                sets = [hashes[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
                part = batch.slice(block.rows.start, len(block))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(sets, pa.binary())], [*(f.name for f in kept), "hashes"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return members.mapInArrow(shingle, f"{schema}, hashes BINARY")


def _judged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, th (hash of the text), n, root (smallest id reached) and first: whether the row stands for its group."""
    th = F.xxhash64(F.coalesce("text", F.lit("")))
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("th", th)
    signed = stage(_signed(given), "signatures")
    # A class is known by its set, so rows that share an id but not a set never meet; its row is the smallest by id and text.
    classes = stage(
        signed.where((F.col("n") > 0) & F.col("id").isNotNull())
        .groupBy(F.col("set").alias("node"))
        .agg(F.min(F.struct("id", "th")).alias("row"), F.first("n").alias("n"), F.min_by("bands", F.struct("id", "th")).alias("bands"), F.min_by("signature", F.struct("id", "th")).alias("signature")),
        "classes",
    )
    dealt = classes.select("node", F.explode("bands").alias("key"))
    buckets = stage(dealt.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    members = classes.select("node", "n", "signature").join(dealt.join(buckets, "key").select("node", "key", "size"), "node")
    met = _block_pairs(members, "size", BUCKET_BLOCK)
    lots = max(1, -(-(buckets.agg(F.sum("size")).first()[0] or 0) // LOT))
    compared = met.groupBy(F.pmod(F.xxhash64("key", "p", "q"), F.lit(lots)).alias("lot"))
    clusters = components(compared.applyInPandas(_similar, "a BINARY, b BINARY"))
    nodes = clusters.unionByName(clusters.select(F.col("root").alias("node"), "root").distinct())
    sizes = nodes.groupBy("root").agg(F.count("*").alias("size"))
    nodes = stage(nodes.join(sizes, "root").join(classes.select("node", "row"), "node").select("node", "root", "size", "row.id", "row.th"), "clusters")
    wanted = nodes.select("id", "th").distinct()
    if nodes.count() <= BROADCAST_NODES:
        # Few of the texts are in a cluster; the others need not travel.
        given = given.join(F.broadcast(wanted), ["id", "th"], "left_semi")
    texts = nodes.join(given, ["id", "th"]).select("node", "root", "size", "text").dropDuplicates(["node"])
    confirmed = _block_pairs(_shingled(texts), "size", CLUSTER_BLOCK).groupBy("root", "p", "q")
    found = components(confirmed.applyInPandas(_linked, "a BINARY, b BINARY"))
    linked = classes.select("node", "row").join(found, "node", "left").select("node", "row", F.coalesce("root", "node").alias("root"))
    first = linked.groupBy("root").agg(F.min("row").alias("first"))
    roots = linked.join(first, "root").select(F.col("node").alias("set"), "first")
    alone = (F.col("n") == 0) | F.col("id").isNull()
    rows = signed.select("id", "th", "n", F.when(~alone, F.col("set")).alias("set")).join(roots, "set", "left")
    own = F.struct("id", "th")
    return rows.select("id", "th", "n", F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("root"), (alone | (F.col("first") == own)).alias("first"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_shingles, component_id and kept of every row.

    1. Each text gets a min-max signature; texts of the same set are one class, known by that set.
    2. Classes meet in the buckets of their bands; those whose signatures agree
       enough are tied to clusters, so a cluster has every link that banding can find.
    3. Within a cluster full sets are compared, by postings of their shingles. Buckets and
       clusters are cut into pairs of blocks, and a task gives the links of a spanning forest
       at most, so neither a task nor the number of rows grows with a group's square.
    4. Components of the confirmed links give each class the smallest id it reaches.

    A pair at the threshold misses all bands with a probability of 5e-6, a closer
    one with less. Null and empty texts have no shingles, and rows with a null id no
    component id of others; both are linked with nothing and kept. Rows that repeat an id are judged by
    their own texts. Sets of equal 128-bit sums count as the same set.
    """
    found = _judged(docs, id_col, text_col)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("root").alias("component_id"), F.col("root").eqNullSafe(F.col("id")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, the one with the smallest id (and text hash), with all its columns.

    Rows that repeat both id and text are one document, rows with a null id or without words groups of their own. A
    row is known by its id and text, so what repeats the id of another text stands or falls by itself.
    """
    place = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    ids, texts = place[id_col], place[text_col]
    # Keys that are never null, so that the join leaves the rows where the last step needs them.
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    kept = _judged(docs.select(id_col, text_col), id_col, text_col).where("first").select(key("id").alias("key"), "th").distinct()
    named = docs.toDF(*place.values()).withColumns({"key": key(ids), "th": F.xxhash64(F.coalesce(F.col(texts).cast("string"), F.lit("")))})
    alone = named.join(kept, ["key", "th"], "left_semi").dropDuplicates(["key", "th"])
    return alone.select(*place.values()).toDF(*docs.columns)
