"""Pointwise mutual information of a co-occurrence table, and the sums behind it."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispectra.operators.cooccurrence import both_ways, either_way
from lexispectra.runtime import file_system, stage

# Row and column sums up to this many ids (some 100 MB as a hash table) are broadcast.
BROADCAST_IDS = 2_000_000
# Up to this id they are read by the tasks (8 bytes an id and kind of sum in each Python worker, so 256 MB).
LOOKUP_IDS = 32_000_000


def row_marginal(cooc: DataFrame) -> DataFrame:
    return cooc.groupBy("row").agg(F.sum("val").alias("row_total"))


def col_marginal(cooc: DataFrame) -> DataFrame:
    return cooc.groupBy("col").agg(F.sum("val").alias("col_total"))


def cooc_total(cooc: DataFrame) -> DataFrame:
    return cooc.agg(F.sum("val").alias("total"))


def matrix_shape(cooc: DataFrame) -> DataFrame:
    """Largest row and column id."""
    return cooc.agg(F.max("row").alias("n_rows"), F.max("col").alias("n_cols"))


def pmi_value(val: Column, row_total: Column, col_total: Column, total: Column) -> Column:
    val, row_total, col_total, total = (c.cast("double") for c in (val, row_total, col_total, total))
    return F.log2(val / (total * (row_total / total) * (col_total / total)))


def pmi(
    cooc: DataFrame,
    cutoff: float | None = None,
    shift: float | None = None,
    symmetric: bool = False,
    mirrored: bool = True,
    once: bool = False,
) -> DataFrame:
    """``row INT, col INT, pmi DOUBLE`` for each cell; sums are taken over all cells.

    ``cutoff`` then keeps the cells with at least that value and ``shift`` is
    added to what is kept. The table is read for each kind of sum and for the
    cells, so stage it first; whole numbers and decimals add up exactly in any order, and the grand
    total is the sum of the row sums. The sums are staged and meet the cells as `_with_sums` says.
    A symmetric table needs only its row sums; one that is not ``mirrored`` has each unordered pair once, and
    cells of both directions come out, or with ``once`` those with the smaller id as the row.
    """
    if not symmetric and (once or not mirrored):
        raise ValueError("only a symmetric table can have each pair once")
    rows = stage(row_marginal(cooc if mirrored else _ends(cooc)), "row-sums")
    total = rows.agg(F.sum("row_total").alias("total"))
    cols = rows.select(F.col("row").alias("col"), F.col("row_total").alias("col_total"))
    if not symmetric:
        cols = stage(col_marginal(cooc), "col-sums")
    cells = cooc.where("row <= col") if once and mirrored else cooc
    cells = _with_sums(cells.select("row", "col", "val"), rows, cols).withColumn("total", total.scalar())
    row, col, val, row_total, col_total = (F.col(c) for c in ("row", "col", "val", "row_total", "col_total"))
    whole = val if mirrored else F.when(row == col, val + val).otherwise(val)
    if mirrored or once:
        value = pmi_value(whole, row_total, col_total, F.col("total"))
    else:
        cells = both_ways(cells)
        value = pmi_value(whole, either_way(row_total, col_total), either_way(col_total, row_total), F.col("total"))
        row, col = either_way(row, col), either_way(col, row)
    cells = cells.select(row.alias("row"), col.alias("col"), value.alias("pmi"))
    if cutoff is not None:
        cells = pmi_cutoff(cells, cutoff)
    return cells if shift is None else pmi_shift(cells, shift)


def _ends(pairs: DataFrame) -> DataFrame:
    """Both words of each unordered pair with its value; a pair of equal words counts twice, as in `mirror`."""
    return pairs.select("row", "val").unionByName(pairs.select(F.col("col").alias("row"), "val"))


def _with_sums(cells: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """The cells with ``row_total`` and ``col_total``.

    Up to `BROADCAST_IDS` sums are broadcast. Above, tasks read them from the shared folder as plain arrays by id, so
    that no cell is shuffled; only ids beyond `LOOKUP_IDS` are joined by shuffle, where Spark splits skewed rows.
    """
    sizes = [sums.agg(F.count("*").alias("n"), F.coalesce(F.max(key), F.lit(0)).alias("last")).first() for sums, key in ((rows, "row"), (cols, "col"))]
    if max(s["n"] for s in sizes) <= BROADCAST_IDS:
        return cells.join(F.broadcast(rows), "row").join(F.broadcast(cols), "col")
    if max(s["last"] for s in sizes) > LOOKUP_IDS:
        return cells.join(rows, "row").join(cols, "col")
    by_row = _doubles(rows, "row", "row_total")
    by_col = _doubles(cols, "col", "col_total")
    lengths = [s["last"] + 1 for s in sizes]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_row, of_col = _sums_by_id(by_row, lengths[0]), _sums_by_id(by_col, lengths[1])
        for batch in batches:
            found = of_row[batch.column("row").to_numpy()], of_col[batch.column("col").to_numpy()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found)], [*batch.schema.names, "row_total", "col_total"])

    added = [T.StructField(name, T.DoubleType()) for name in ("row_total", "col_total")]
    return cells.mapInArrow(look_up, T.StructType([*cells.schema.fields, *added]))


def _doubles(sums: DataFrame, key: str, value: str) -> tuple[str, ...]:
    """Files of a staged table ``id, sum`` with the sums as the numbers that the PMI is taken from."""
    return tuple(stage(sums.select(F.col(key).alias("id"), F.col(value).cast("double").alias("sum")), "sums").inputFiles())


# Tables of sums that this Python worker has read; it keeps those of one table of cells for its next task.
_read: dict[tuple[str, ...], np.ndarray] = {}


def _sums_by_id(files: tuple[str, ...], length: int) -> np.ndarray:
    if files not in _read:
        while len(_read) > 1:
            del _read[next(iter(_read))]
        sums = np.zeros(length)
        for name in files:
            store, path = file_system(unquote(name))
            with store.open_input_file(path) as file:
                for batch in pq.ParquetFile(file).iter_batches(1 << 20, use_threads=False):
                    sums[batch.column("id").to_numpy()] = batch.column("sum").to_numpy()
        _read[files] = sums
    return _read[files]


def pmi_cutoff(cells: DataFrame, cutoff: float) -> DataFrame:
    return cells.where(F.col("pmi") >= F.lit(float(cutoff)))


def pmi_shift(cells: DataFrame, shift: float) -> DataFrame:
    return cells.withColumn("pmi", F.col("pmi") + F.lit(float(shift)))
