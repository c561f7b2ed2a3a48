"""Corpus files by byte ranges, so that a line of any length is read by many tasks in bounded memory.

Lines of up to ``line_bytes`` bytes come whole. A longer one is cut between words where a range ends:
its parts in different ranges are *segments*, which `operators.borders` joins up again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispectra.functions.encoding import decode_text
from lexispectra.functions.text import MAX_WORD_BYTES
from lexispectra.runtime import file_system, stage
from lexispectra.sources.corpus import read_corpus

SPLIT_BYTES = 64 * 1024 * 1024
LINE_BYTES = 1024 * 1024
_PROBE_BYTES = 64 * 1024
_BATCH_BYTES = 4 * 1024 * 1024
# Tasks that a corpus of many short ranges is dealt to; larger ones have one for each `SPLIT_BYTES`.
_TASKS_PER_CORE = 4
# Enough of an overlong word to truncate it by characters later.
_WORD_HEAD = MAX_WORD_BYTES + 25
# Names of files that Hadoop decompresses while reading, which cannot be cut by bytes.
COMPRESSED = (".bz2", ".deflate", ".gz", ".lz4", ".snappy", ".zst")

_RANGE = "path STRING, file INT, split BIGINT, begin BIGINT, nominal BIGINT, end BIGINT, opens BOOLEAN, goes_on BOOLEAN"
_PIECE = "file INT, line_id BIGINT, base INT, opens BOOLEAN, goes_on BOOLEAN, value BINARY"


def _first(block: bytes, *marks: bytes) -> int:
    return min((k for k in map(block.find, marks) if k >= 0), default=-1)


def find_cut(stream: pa.NativeFile, at: int, size: int, line_bytes: int) -> tuple[int, bool]:
    """Where the range that should end at ``at`` ends, and whether a line ends there.

    That is after the first newline from ``at - 1`` on, or at the end of the file, if it is within ``line_bytes``;
    else after the first separator, however far. It depends on ``at`` alone, so both neighbours agree.
    """
    if at <= 0 or at >= size:
        return max(0, min(at, size)), True
    position, near, space = at - 1, min(at - 1 + line_bytes, size), -1
    stream.seek(position)
    while position < near:
        block = stream.read(min(_PROBE_BYTES, near - position))
        newline = block.find(b"\n")
        if newline >= 0:
            return position + newline + 1, True
        if space < 0 <= (k := _first(block, b" ", b"\t")):
            space = position + k
        position += len(block)
    if near == size:
        return size, True
    if space >= 0:
        return space + 1, False
    while position < size:
        block = stream.read(LINE_BYTES)
        k = _first(block, b" ", b"\t", b"\n")
        if k >= 0:
            return position + k + 1, block[k : k + 1] == b"\n"
        position += len(block)
    return size, True


def read_range(stream: pa.NativeFile, begin: int, nominal: int, end: int, line_bytes: int) -> bytes:
    """The bytes of a range. Those far behind its nominal end belong to one overlong word, of which the head is kept."""
    near = min(end, max(begin, nominal + line_bytes))
    stream.seek(begin)
    data, position, tail = stream.read(near - begin), near, b""
    while position < end and len(tail) < _WORD_HEAD:
        block = stream.read(min(LINE_BYTES, end - position))
        position += len(block)
        tail = (tail + block.replace(b"\r", b""))[:_WORD_HEAD]
    return data + tail.rstrip(b"\n")


def cut_line(line: bytes, size: int) -> Iterator[tuple[int, bytes]]:
    """A line in parts of up to ``size`` bytes, cut between words, each with the number of fields before it."""
    base, start = 0, 0
    while start < len(line):
        if len(line) - start <= size:
            stop = len(line)
        else:
            stop = max(line.rfind(mark, start, start + size) for mark in (b" ", b"\t"))
            if stop < 0:
                found = (line.find(mark, start + size) for mark in (b" ", b"\t"))
                stop = min((k for k in found if k >= 0), default=len(line))
        part = line[start:stop]
        if len(part) > size:
            part = part.replace(b"\r", b"")[:_WORD_HEAD]
        yield base, part
        base += part.count(b" ") + part.count(b"\t") + 1
        start = stop + 1


def _rows(data: bytes, file: int, split: int, opens: bool, goes_on: bool, line_bytes: int) -> Iterator[pa.RecordBatch]:
    lines = data.split(b"\n")
    if not lines[-1] and data.endswith(b"\n"):
        lines.pop()
    number, base, values = np.arange(len(lines), dtype=np.int64), np.zeros(len(lines), np.int32), lines
    if max(map(len, lines), default=0) > line_bytes:
        parts = [(i, b, v) for i, line in enumerate(lines) for b, v in (cut_line(line, line_bytes) if line else [(0, line)])]
        number, base = (np.array([p[k] for p in parts], kind) for k, kind in ((0, np.int64), (1, np.int32)))
        values = [p[2] for p in parts]
    columns = [
        np.full(len(values), file, np.int32),
        (split << 32) + number,
        base,
        (number == 0) & opens,
        (number == len(lines) - 1) & goes_on,
    ]
    table = pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(values, pa.binary())], ["file", "line_id", "base", "opens", "goes_on", "value"])
    filled = np.cumsum([len(v) for v in values]) // _BATCH_BYTES
    edges = [0, *(np.flatnonzero(np.diff(filled)) + 1).tolist(), len(values)]
    for a, b in zip(edges, edges[1:]):
        yield table.slice(a, b - a)


def read_corpus_pieces(
    spark: SparkSession,
    path: str | list[str],
    encoding: str | None = None,
    split_bytes: int = SPLIT_BYTES,
    line_bytes: int = LINE_BYTES,
) -> DataFrame:
    """Text files as ``file INT, line_id BIGINT, base INT, opens, goes_on, cut BOOLEAN, line STRING``.

    A row is a line or, of a line over ``line_bytes``, a part of it between two separators. Parts with the same ``line_id``
    stand together and in order; ``base`` is the number of fields before a part. A range that ends inside a
    line gives it another ``line_id`` in the next: ``goes_on`` and ``opens`` mark such segments, ``cut`` the rows of all ranges that
    begin or end so, and a filter on ``cut`` leaves the other ranges unread. Empty files have no lines. Compressed files are refused.

    A task holds one range at a time, some ``split_bytes + line_bytes``. An overlong word is kept up to its head. A boundary inside a word is
    looked for up to the word's end, so only a word longer than many ranges is read more than twice.
    """
    if split_bytes < 1 or line_bytes < 1:
        raise ValueError("split_bytes and line_bytes must be positive")
    # One row per file, as Spark's own scans list them; the contents are not read here.
    listed = spark.read.format("binaryFile").load(path).select("path", "length").collect()
    if any(r["path"].lower().endswith(COMPRESSED) for r in listed):
        raise ValueError("compressed files cannot be cut; read them with read_corpus")
    rows, first = [], 0
    for file, (name, length) in enumerate(sorted(map(tuple, listed))):
        rows.append((name, file, length, first))
        first += -(-length // split_bytes)
    files = spark.createDataFrame(rows, "path STRING, file INT, length BIGINT, first BIGINT").where("length > 0")
    step = F.lit(split_bytes).cast("bigint")
    starts = F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, step)).alias("k", "start")
    total = sum(r[2] for r in rows)
    # Short ranges share a task, one after the other.
    tasks = max(1, min(first, max(-(-total // SPLIT_BYTES), _TASKS_PER_CORE * spark.sparkContext.defaultParallelism)))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name, file, size, split, start in zip(*(c.to_pylist() for c in batch.columns)):
                nominal = min(start + split_bytes, size)
                store, place = file_system(name)
                with store.open_input_file(place) as stream:
                    (begin, whole), (end, ends) = (find_cut(stream, at, size, line_bytes) for at in (start, nominal))
                found.append((name, file, split, begin, nominal, end, not whole, not ends))
            kinds = [pa.string(), pa.int32(), *[pa.int64()] * 4, *[pa.bool_()] * 2]
            names = ["path", "file", "split", "begin", "nominal", "end", "opens", "goes_on"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found) if found else [()] * 8, kinds)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, file, split, begin, nominal, end, opens, goes_on in zip(*(c.to_pylist() for c in batch.columns)):
                store, place = file_system(name)
                with store.open_input_file(place) as stream:
                    data = read_range(stream, begin, nominal, end, line_bytes)
                yield from _rows(data, file, split, opens, goes_on, line_bytes)

    ranges = files.select("path", "file", "length", "first", starts)
    ranges = ranges.select("path", "file", "length", (F.col("first") + F.col("k")).alias("split"), "start")
    ranges = stage(ranges.repartition(tasks, "split").mapInArrow(probe, _RANGE).where("begin < end"), "corpus-ranges")

    def pieces(some: DataFrame, cut: bool) -> DataFrame:
        ordered = some.repartition(tasks, "split").sortWithinPartitions("split")
        return ordered.mapInArrow(read, _PIECE).withColumn("cut", F.lit(cut))

    is_cut = F.col("opens") | F.col("goes_on")
    found = pieces(ranges.where(~is_cut), False).unionByName(pieces(ranges.where(is_cut), True))
    return found.withColumn("line", decode_text(F.col("value").cast("string"), encoding)).drop("value")


def read_corpus_files(spark: SparkSession, path: str | list[str], encoding: str | None = None) -> DataFrame:
    """Files by byte ranges, or by whole lines where any of them is compressed."""
    names = spark.read.format("binaryFile").load(path).inputFiles()
    if any(name.lower().endswith(COMPRESSED) for name in names):
        return read_corpus(spark, path, encoding)
    return read_corpus_pieces(spark, path, encoding)
