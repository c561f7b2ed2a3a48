"""Pairs of words that stand in different segments of one line, see `sources.pieces`."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispectra.operators.encoding import BROADCAST_BYTES, encode
from lexispectra.operators.windows import check_window
from lexispectra.runtime import stage


def is_cut(lines: DataFrame) -> bool:
    """Whether lines may come in segments."""
    return {"line_id", "opens", "goes_on", "cut"} <= set(lines.columns)


def segment_ends(coded: DataFrame, window: int) -> DataFrame:
    """The first and last ``window`` words of every line: ``line_id BIGINT, place BIGINT, id INT, n BIGINT``.

    ``place`` counts the line's words from 0, ``n`` is their number. A task holds two windows of words.
    """

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line, n, head, tail = None, 0, np.zeros(0, np.int32), np.zeros(0, np.int32)

        def done() -> pa.RecordBatch:
            rest = tail[max(0, len(tail) - (n - len(head))) :] if n > len(head) else tail[:0]
            place = np.append(np.arange(len(head)), np.arange(n - len(rest), n))
            columns = [np.full(len(place), line), place.astype(np.int64), np.append(head, rest), np.full(len(place), n)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["line_id", "place", "id", "n"])

        for batch in batches:
            lines, ids = batch.column("line_id").to_numpy(), batch.column("id").to_numpy()
            starts = np.flatnonzero(np.append(True, lines[1:] != lines[:-1])) if len(lines) else []
            for a, b in zip(starts, [*starts[1:], len(lines)]):
                if lines[a] != line:
                    if line is not None:
                        yield done()
                    line, n, head, tail = lines[a], 0, head[:0], tail[:0]
                head = np.append(head, ids[a : min(b, a + window - len(head))])
                tail = np.append(tail, ids[max(a, b - window) : b])[-window:]
                n += int(b - a)
        if line is not None:
            yield done()

    return coded.select("line_id", "pos", "id").mapInArrow(ends, "line_id BIGINT, place BIGINT, id INT, n BIGINT")


def border_pairs(lines: DataFrame, vocab: DataFrame, window: int, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Pairs within ``window`` words whose segments differ: ``left_id INT, right_id INT, distance INT``.

    Each segment gives at most its first and last ``window`` words. Running sums over the segments of a file (one row
    a range) number them through the line, and a join on line and number finds the pairs: no key is a line.
    Segments without known words count as empty, so a pair may reach over several.
    """
    check_window(window)
    segments = lines.where(F.col("cut") & (F.col("opens") | F.col("goes_on")))
    ends = stage(segment_ends(encode(segments, vocab, broadcast_bytes=broadcast_bytes), window), "segment-ends")
    sizes = ends.groupBy("line_id").agg(F.first("n").alias("n"))
    known = segments.select("file", "line_id", "opens").distinct().join(sizes, "line_id", "left")
    in_file = Window.partitionBy("file").orderBy("line_id")
    known = known.withColumn("chain", F.sum(F.when(F.col("opens"), 0).otherwise(1)).over(in_file))
    before = Window.partitionBy("file", "chain").orderBy("line_id").rowsBetween(Window.unboundedPreceding, -1)
    known = known.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    words = ends.join(known.select("file", "chain", "line_id", "before"), "line_id")
    words = stage(words.select("file", "chain", "line_id", (F.col("before") + F.col("place")).alias("place"), "id"), "border-words")
    left = words.select("file", "chain", "place", F.col("line_id").alias("left_line"), F.col("id").alias("left_id"))
    right = words.withColumnRenamed("id", "right_id").withColumn("distance", F.explode(F.sequence(F.lit(1), F.lit(window))))
    right = right.withColumn("place", F.col("place") - F.col("distance"))
    found = right.join(left, ["file", "chain", "place"]).where("left_line < line_id")
    return found.select("left_id", "right_id", "distance")
