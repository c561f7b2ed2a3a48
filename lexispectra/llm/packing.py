"""Best-fit packing of tokenised documents into sequences, certified by lower bounds."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispectra.llm.encoder import encoder, tokenizer_path
from lexispectra.runtime import stage

CAPACITY = 2048
#: Pieces that one task packs at a time; the number of tasks grows with the pieces.
GROUP = 4_000
#: Rounds of exchange between partitions whose bound leaves a gap.
ROUNDS = 3
_TEXTS = 256


def pieces(docs: DataFrame, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document: piece, start, length and checksum of its ids.

    Only documents of more than ``capacity`` ids are cut: into full pieces, of
    which the first may be shorter. A null or empty text has the end id alone.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path(tokenizer), end, True).encode
        for batch in batches:
            for part in (batch.slice(i, _TEXTS) for i in range(0, batch.num_rows, _TEXTS)):
                ids, bounds = encode(part.column("text").to_pylist())
                size = np.diff(bounds)
                n = -(-size // capacity)
                row = np.repeat(np.arange(len(size)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                stop = size[row] - (n[row] - 1 - piece) * capacity
                start = np.maximum(stop - capacity, 0)
                data = ids.astype("<u4", copy=False).view(np.uint8)
                a, b = 4 * (bounds[:-1][row] + start), 4 * (bounds[:-1][row] + stop)
                crc = [zlib.crc32(data[i:j]) for i, j in zip(a.tolist(), b.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(stop - start), pa.array(crc, pa.int64())],
                    ["id", "piece", "start", "length", "ids_crc32"],
                )

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(cut, f"id {kind}, piece INT, start BIGINT, length BIGINT, ids_crc32 BIGINT")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Least number of sequences that can hold the lengths, by dual feasible functions.

    The threshold functions (long items count in full, short ones not at all) and
    the rounding functions of k steps; each gives a valid bound, the best holds.
    """
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1)
    items = np.append(0, np.cumsum(count))  # items shorter than i
    total = np.append(0, np.cumsum(count * sizes))
    a = np.arange(capacity // 2 + 1)
    scaled = (items[-1] - items[capacity - a + 1]) * capacity + np.maximum(total[capacity - a + 1] - total[a], 0)
    best = -int((-scaled // capacity).min())
    for k in range(1, 33):
        steps = (k + 1) * sizes
        value = np.where(steps % capacity == 0, sizes * k, steps // capacity * capacity)  # k * capacity * u(x)
        best = max(best, -(-int((value * count).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit decreasing: bin and offset of each length, and the space left in each bin."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if some bin has r left
    left: list[int] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            chosen = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            room, chosen = capacity, len(left)
            left.append(capacity)
        bins[i], offsets[i] = chosen, capacity - room
        left[chosen] = room - size
        if room > size:
            with_room[room - size].append(chosen)
            rooms |= 1 << (room - size)
    return bins, offsets, np.array(left, np.int64)


_PLACED = "id {}, piece INT, start BIGINT, length BIGINT, ids_crc32 BIGINT, grp BIGINT, bin BIGINT, offset BIGINT, open BOOLEAN, gap BIGINT"


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """Place every piece: adds sequence_id and offset.

    Pieces are dealt by a hash of their row number to groups of about ``group``; each group is packed by
    best fit decreasing and compared with its lower bound. Groups with a gap
    then hand the content of their unfilled sequences to joint groups, which pack
    anew and keep the better of both results; full sequences and certified
    groups stay. Nothing but one row per group reaches the driver. An empty
    table gives an empty result; repeated rows are pieces of their own.
    """
    kind = pieces.schema["id"].dataType.simpleString()
    schema = _PLACED.format(kind)
    rows = stage(pieces, "pieces")
    n = max(1, -(-rows.where(F.col("length") < capacity).count() // group))
    dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n))

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        lengths = frame["length"].to_numpy()
        bins, offsets, left = best_fit(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        if "was" in frame and frame["was"].nunique() <= len(left):
            # The earlier placement is no worse: keep it.
            bins, _ = pd.factorize(frame["was"])
            order = np.lexsort((frame["offset"].to_numpy(), bins))
            left = capacity - np.bincount(bins, lengths).astype(np.int64)
            offsets = np.empty(len(frame), np.int64)
            ends = np.cumsum(lengths[order])
            starts = ends - lengths[order]
            first = np.searchsorted(bins[order], np.arange(len(left)))
            offsets[order] = starts - starts[first][bins[order]]
        out = frame[["id", "piece", "start", "length", "ids_crc32", "grp"]].copy()
        out["bin"], out["offset"] = bins, offsets
        out["open"] = left[bins] > 0
        out["gap"] = len(left) - bound
        return out

    full = rows.where(F.col("length") >= capacity)
    placed = stage(rows.where(F.col("length") < capacity).withColumn("grp", dealt).groupBy("grp").applyInPandas(place, schema), "packed")
    done = []
    for _ in range(rounds):
        moving = F.col("open") & (F.col("gap") > 0)
        state = placed.where(moving).agg(F.countDistinct("grp").alias("groups"), F.count("*").alias("items")).first()
        if state["groups"] < 2:
            break
        done.append(placed.where(~moving))
        joint = max(1, -(-state["items"] // group))
        if joint >= state["groups"]:
            joint = max(1, state["groups"] // 2)
        exchanged = (
            placed.where(moving)
            .withColumn("was", F.struct("grp", "bin").cast("string"))
            .withColumn("grp", F.pmod(F.xxhash64("grp"), F.lit(joint)))
            .drop("bin", "open", "gap")
        )
        placed = stage(exchanged.groupBy("grp").applyInPandas(place, schema), "packed")
    done.append(placed)
    columns = ["id", "piece", "start", "length", "ids_crc32"]
    # Numbers of sequences: round, group and bin; a full piece has one of its own.
    found = [
        d.select(*columns, (F.lit(k + 1) * F.lit(1 << 58) + F.col("grp") * F.lit(1 << 24) + F.col("bin")).alias("sequence_id"), "offset")
        for k, d in enumerate(done)
    ]
    found.append(full.select(*columns, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")))
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end: int = 0, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Tokenise whole documents and pack them; one row per piece."""
    return pack(pieces(docs, tokenizer, end, id_col, text_col, capacity), capacity).withColumnRenamed("id", id_col)
