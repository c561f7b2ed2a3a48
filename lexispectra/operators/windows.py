"""Context windows over encoded lines.

The input keeps each line whole and in order inside one partition, as `encode`
delivers it, so windows slide over the Arrow batches of a partition without any
shuffle or per-line group: state is the last ``window`` words, whatever the
length of a line. The work inside a batch is vectorised over all its words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Pairs that are formed and pre-aggregated at a time in one task (about 100 MB).
PAIRS_PER_STEP = 4_000_000


def check_window(window: int) -> int:
    if isinstance(window, bool) or not isinstance(window, int) or window < 1:
        raise ValueError(f"window must be a positive whole number, not {window!r}")
    return window


@dataclass
class _Step:
    """Some consecutive words of a partition; the first ``seen`` are repeated for context."""

    table: pa.Table
    seen: int

    def column(self, name: str) -> np.ndarray:
        return self.table.column(name).to_numpy()

    def pairs(self, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers (left, right) of the new words' partners at one distance."""
        line = self.column("line_id")
        right = np.arange(max(self.seen, distance), len(line))
        right = right[line[right] == line[right - distance]]
        return right - distance, right


def steps(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[_Step]:
    """Regroup a partition's batches into steps that overlap by ``window`` words."""
    target = max(1, PAIRS_PER_STEP // window)
    held: pa.Table | None = None
    waiting: list[pa.RecordBatch] = []
    rows = 0

    def step() -> _Step:
        nonlocal held, rows
        fresh = pa.Table.from_batches(waiting)
        table = fresh if held is None else pa.concat_tables([held, fresh])
        seen = 0 if held is None else held.num_rows
        _check_order(table)
        held = table.slice(max(0, table.num_rows - window))
        waiting.clear()
        rows = 0
        return _Step(table, seen)

    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            rows += batch.num_rows
        if rows >= target:
            yield step()
    if waiting:
        yield step()


def _check_order(table: pa.Table) -> None:
    line = table.column("line_id").to_numpy()
    pos = table.column("pos").to_numpy()
    ahead = (line[1:] > line[:-1]) | ((line[1:] == line[:-1]) & (pos[1:] > pos[:-1]))
    if not ahead.all():
        raise ValueError("the words of a line are not together and in order; encode the corpus again")


def _fields(coded: DataFrame, names: Sequence[str]) -> list[T.StructField]:
    return [coded.schema[n] for n in names]


def line_position(coded: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Number the in-vocabulary words of each line from 1: carried columns, ``position INT, id``."""
    carry = list(carry)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_line, last_number = None, 0
        for step in steps(batches, 1):
            line = step.column("line_id")[step.seen :]
            starts = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
            first = np.repeat(starts, np.diff(np.append(starts, len(line))))
            position = np.arange(len(line)) - first + 1
            if line[0] == last_line:
                position[: starts[1] if len(starts) > 1 else None] += last_number
            last_line, last_number = line[-1], int(position[-1])
            table = step.table.slice(step.seen)
            columns = [*(table.column(c) for c in carry), pa.array(position, pa.int32()), table.column("id")]
            yield from pa.table(columns, names=[*carry, "position", "id"]).to_batches()

    schema = T.StructType([*_fields(coded, carry), T.StructField("position", T.IntegerType()), coded.schema["id"]])
    return coded.select("line_id", "pos", "id", *carry).mapInArrow(number, schema)


def context_window(coded: DataFrame, window: int, carry: Sequence[str] = ()) -> DataFrame:
    """Each word with up to ``window`` ids before it, oldest first: ..., ``pos, id, context ARRAY<INT>``."""
    check_window(window)
    carry = list(carry)

    def attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, window):
            line, ids = step.column("line_id"), step.column("id")
            right = np.arange(step.seen, len(line))
            left = right[:, None] - np.arange(window, 0, -1)[None, :]
            inside = (left >= 0) & (line[np.maximum(left, 0)] == line[right][:, None])
            offsets = np.concatenate(([0], np.cumsum(inside.sum(axis=1))))
            context = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids[left[inside]], pa.int32()))
            table = step.table.slice(step.seen)
            columns = [*(table.column(c) for c in carry), table.column("pos"), table.column("id"), context]
            yield from pa.table(columns, names=[*carry, "pos", "id", "context"]).to_batches()

    schema = T.StructType(
        [*_fields(coded, [*carry, "pos", "id"]), T.StructField("context", T.ArrayType(T.IntegerType()))]
    )
    return coded.select("line_id", "pos", "id", *carry).mapInArrow(attach, schema)


def window_pairs(coded: DataFrame, window: int, carry: Sequence[str] = ()) -> DataFrame:
    """Every word with each of its ``window`` predecessors on the line.

    Carried columns, ``left_id INT, right_id INT, distance INT``; ``pos`` is that of the right word.
    """
    check_window(window)
    carry = list(carry)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, window):
            ids = step.column("id")
            for d in range(1, window + 1):
                left, right = step.pairs(d)
                table = step.table.take(pa.array(right))
                columns = [
                    *(table.column(c) for c in [*carry, "pos"]),
                    pa.array(ids[left], pa.int32()),
                    pa.array(ids[right], pa.int32()),
                    pa.array(np.full(len(right), d), pa.int32()),
                ]
                names = [*carry, "pos", "left_id", "right_id", "distance"]
                yield from pa.table(columns, names=names).to_batches()

    added = [T.StructField(n, T.IntegerType()) for n in ("left_id", "right_id", "distance")]
    schema = T.StructType([*_fields(coded, [*carry, "pos"]), *added])
    return coded.select("line_id", "pos", "id", *carry).mapInArrow(pair, schema)


def packed_pairs(step: _Step, window: int, symmetric: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (row, col, distance) of a step's pairs in rising order, and how often each occurs.

    The three numbers share one 64-bit integer, so that a plain sort groups them.
    """
    ids, names = step.column("id").astype(np.int64), None
    low, wide = window.bit_length(), int(ids.max()).bit_length()
    if 2 * wide + low > 63:
        # Number the words of this step instead; there are few enough.
        names, ids = np.unique(ids, return_inverse=True)
        wide = len(names).bit_length()
    line = step.column("line_id")
    found = []
    for d in range(1, window + 1):
        first = max(step.seen, d)
        left, right = slice(first - d, max(len(line) - d, 0)), slice(first, None)
        same = line[left] == line[right]
        a, b = ids[left][same], ids[right][same]
        if symmetric:
            a, b = np.minimum(a, b), np.maximum(a, b)
        found.append((((a << wide) | b) << low) | d)
    packed = np.concatenate(found)
    packed.sort()
    starts = run_starts(packed)
    n = np.diff(np.append(starts, len(packed)))
    packed = packed[starts]
    row, col, distance = packed >> (wide + low), (packed >> low) & ((1 << wide) - 1), packed & ((1 << low) - 1)
    if names is not None:
        row, col = names[row], names[col]
    return row, col, distance, n


def run_starts(*ordered: np.ndarray) -> np.ndarray:
    """Where a new combination of values begins."""
    new = np.zeros(len(ordered[0]), bool)
    new[:1] = True
    for column in ordered:
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)
