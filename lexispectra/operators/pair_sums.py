"""Weights of pairs of words, added up by blocks of a grid of ids.

Each task adds up its pairs in sorted arrays of at most `HELD` entries. What it gives away is cut
by ``(id mod bands)`` of both words, which spreads the pairs of frequent words over many blocks, and
packed: the sorted cells of a block as differences and the sums beside them, byte by byte, compressed. A
pair takes some two to four bytes on its way, and a block's task adds up what all tasks found for its cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispectra.operators.windows import check_window, packed_pairs, run_starts, steps

# Entries that a task holds before they are added up; what is left goes out when it is over half of them.
HELD = 8_000_000
# Pairs of a block of the grid before they are added up, and blocks per core at least.
BLOCK_PAIRS = 16_000_000
_BLOCKS_PER_CORE = 4
# Characters of a word with its separator, to guess the number of pairs from the size of a corpus.
_WORD_CHARS = 6
# Bits of an id.
_ID_BITS = 31
_PACKED = "p INT, q INT, n INT, width BIGINT, cells ARRAY<BINARY>, sums ARRAY<ARRAY<BINARY>>"


def choose_bands(corpora: Sequence[DataFrame], window: int) -> int:
    """Bands of ids so that a block of the grid has about `BLOCK_PAIRS` pairs; one scan of the lines' lengths."""
    chars = sum(lines.agg(F.sum(F.octet_length("line").cast("bigint")).alias("n")).first()["n"] or 0 for lines in corpora)
    blocks = max(chars // _WORD_CHARS * window / BLOCK_PAIRS, _BLOCKS_PER_CORE * corpora[0].sparkSession.sparkContext.defaultParallelism)
    return math.ceil(math.sqrt(blocks))


def _planes(numbers: np.ndarray) -> list[bytes]:
    """Whole numbers from 0 as compressed bytes of equal rank, without the leading zeros that all share."""
    size = -(-int(numbers.max(initial=0)).bit_length() // 8)
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T)
    return [pa.compress(plane, codec="zstd", asbytes=True) for plane in planes]


def _numbers(planes: Sequence[bytes], n: int) -> np.ndarray:
    found = np.zeros((n, 8), np.uint8)
    for k, plane in enumerate(planes):
        found[:, k] = np.frombuffer(pa.decompress(plane, n, codec="zstd"), np.uint8)
    return found.reshape(-1).view("<i8")


class _Sums:
    """Sorted cells, as one number each, and the sums of their weights; one row of sums for each kind of weight."""

    def __init__(self) -> None:
        self._cells: list[np.ndarray] = []
        self._sums: list[np.ndarray] = []
        self._merged = 0

    @property
    def size(self) -> int:
        return sum(map(len, self._cells))

    def add(self, cells: np.ndarray, sums: np.ndarray) -> None:
        self._cells.append(cells)
        self._sums.append(sums)
        # A block of more cells than HELD is merged again only when it has grown by a quarter.
        if self.size > max(HELD, self._merged + self._merged // 4) and len(self._cells) > 1:
            self.merge()

    def merge(self) -> None:
        if len(self._cells) > 1:
            cells, sums = np.concatenate(self._cells), np.concatenate(self._sums, axis=1)
            self._cells, self._sums = [], []
            order = np.argsort(cells, kind="stable")
            cells = cells[order]
            starts = run_starts(cells)
            self._sums.append(np.stack([np.add.reduceat(s[order], starts) for s in sums]) if len(starts) else sums)
            self._cells.append(cells[starts])
            self._merged = len(starts)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        found = self._cells[0], self._sums[0]
        self._cells, self._sums, self._merged = [], [], 0
        return found


def _packed(cells: np.ndarray, sums: np.ndarray, bands: int) -> pa.RecordBatch:
    """One row for each block of the grid that has cells."""
    row, col = (cells >> _ID_BITS) - 1, (cells & ((1 << _ID_BITS) - 1)) - 1
    block = (row % bands) * bands + col % bands
    order = np.argsort(block.astype(np.uint16 if bands < 256 else np.int64), kind="stable")
    block, sums = block[order], sums[:, order]
    row, col = row[order] // bands, col[order] // bands
    starts = run_starts(block)
    found = []
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(block)]):
        width = int(col[a:b].max()) + 1
        apart = np.diff(row[a:b] * width + col[a:b], prepend=0)
        found.append((int(block[a]) // bands, int(block[a]) % bands, b - a, width, _planes(apart), [_planes(s[a:b]) for s in sums]))
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.list_(pa.binary()))]
    columns = [pa.array(list(values), kind) for values, kind in zip(zip(*found), kinds)]
    return pa.RecordBatch.from_arrays(columns, ["p", "q", "n", "width", "cells", "sums"])


def _collected(found: Iterator[tuple[np.ndarray, ...]], worth: np.ndarray, bands: int) -> Iterator[pa.RecordBatch]:
    """Sorted groups of (row, col, distance, number) to packed blocks."""
    held = _Sums()
    for row, col, distance, n in found:
        if len(row):
            starts = run_starts(row, col)
            cells = (row[starts].astype(np.int64) << _ID_BITS) | col[starts]
            held.add(cells, np.stack([np.add.reduceat(w[distance] * n, starts) for w in worth]))
            if held.size > HELD // 2:
                held.merge()
                if held.size > HELD // 2:
                    yield _packed(*held.take(), bands)
    if held.size:
        yield _packed(*held.take(), bands)


def pack_pairs(coded: DataFrame, window: int, worth: Sequence[Sequence[int]], symmetric: bool, bands: int, more: DataFrame | None = None) -> DataFrame:
    """The pairs of an encoded corpus as packed blocks, which `add_packed` adds up.

    Each row of ``worth`` has whole weights for the distances 1 to ``window`` and gives one of the sums. ``row`` is the left
    word. In the symmetric form both orders of a pair count as one with the smaller id as ``row``. ``more`` has further
    pairs ``row, col, distance``.
    """
    check_window(window)
    values = np.array([[0, *w] for w in worth], np.int64)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _collected((packed_pairs(s, window, symmetric) for s in steps(batches, window)), values, bands)

    def pack_more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ordered() -> Iterator[tuple[np.ndarray, ...]]:
            for batch in batches:
                row, col, distance = (batch.column(c).to_numpy() for c in ("row", "col", "distance"))
                order = np.lexsort((col, row))
                yield row[order], col[order], distance[order], np.ones(len(order), np.int64)

        return _collected(ordered(), values, bands)

    packed = coded.select("line_id", "pos", "id").mapInArrow(pack, _PACKED)
    return packed if more is None else packed.unionByName(more.select("row", "col", "distance").mapInArrow(pack_more, _PACKED))


def add_packed(packed: DataFrame, bands: int) -> DataFrame:
    """``row INT, col INT, sums ARRAY<BIGINT>``: for each pair of words the sums of its weights, one row a pair."""

    def add(key: tuple, some: pa.Table) -> pa.Table:
        p, q = (k.as_py() for k in key)
        held = _Sums()
        for batch in some.to_batches(max_chunksize=64):
            for n, width, cells, sums in zip(*(batch.column(c).to_pylist() for c in ("n", "width", "cells", "sums"))):
                at = np.cumsum(_numbers(cells, n))
                held.add(((at // width) << _ID_BITS) | at % width, np.stack([_numbers(s, n) for s in sums]))
        cells, sums = held.take()
        row, col = (cells >> _ID_BITS) * bands + p + 1, (cells & ((1 << _ID_BITS) - 1)) * bands + q + 1
        offsets = np.arange(len(cells) + 1, dtype=np.int32) * len(sums)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(sums.T).reshape(-1)))
        return pa.table([pa.array(row.astype(np.int32)), pa.array(col.astype(np.int32)), lists], names=["row", "col", "sums"])

    return packed.groupBy("p", "q").applyInArrow(add, "row INT, col INT, sums ARRAY<BIGINT>")
