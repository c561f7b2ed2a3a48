"""Global row numbers without a one-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispectra.runtime import stage

# monotonically_increasing_id() is the partition number above 33 bits of row number.
_ROW_BITS = 33


def with_global_rank(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Add ``name INT``, the 1-based position of each row in the total order ``order``.

    A range shuffle sorts the rows in parallel; each row then needs only the
    number of rows in the partitions before its own, a table with one row per
    partition. ``order`` should be unique per row, so that ties are split too.
    """
    placed = stage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id()),
        "ranked",
    )
    part = F.shiftright("_slot", _ROW_BITS).alias("_part")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part)
        .agg(F.count("*").alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    )
    row = F.col("_slot").bitwiseAND((1 << _ROW_BITS) - 1)
    return (
        placed.withColumn("_part", F.shiftright("_slot", _ROW_BITS))
        .join(F.broadcast(offsets), "_part")
        .select((F.col("_before") + row + 1).cast("int").alias(name), *df.columns)
    )
