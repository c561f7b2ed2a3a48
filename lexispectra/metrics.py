"""Sizes of a run, counted while its tables are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# What a training run reports, in order.
RUN_METRICS = ["tokens", "distinct_words", "vocabulary", "tokens_in_vocabulary", "cells", "cells_kept"]


class RunMetrics:
    """Collects sizes from the writes of one run, so that no table is read for them.

    A run with a given vocabulary or given counts has no metrics of the steps it leaves out.
    """

    def __init__(self) -> None:
        self._watched: list[Observation] = []

    def watch(self, table: DataFrame, **found: Column) -> DataFrame:
        """The same table; ``found`` are aggregates over its rows.

        The next action on it must compute each row once: a range shuffle, say, would sample it first
        and count rows twice.
        """
        observation = Observation()
        self._watched.append(observation)
        return table.observe(observation, *[F.coalesce(v, F.lit(0)).cast("bigint").alias(k) for k, v in found.items()])

    def values(self) -> dict[str, int]:
        """What the run has found; waits for tables that are still to be written."""
        found: dict[str, int] = {}
        for observation in self._watched:
            found |= observation.get
        return {name: found[name] for name in RUN_METRICS if name in found}

    def table(self, spark: SparkSession) -> DataFrame:
        """``metric STRING, value BIGINT``."""
        return spark.createDataFrame(list(self.values().items()), "metric STRING, value BIGINT")
