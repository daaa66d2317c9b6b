"""The step grid and the fan-out of rows to the steps whose window covers them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N


@dataclass(frozen=True)
class Grid:
    """Steps start, start + step, ... up to end, in milliseconds."""

    start: int
    end: int
    step: int

    @property
    def last(self) -> int:
        return self.start + (self.end - self.start) // self.step * self.step

    def steps(self, spark: SparkSession) -> DataFrame:
        return spark.range(self.start, self.last + 1, self.step).withColumnRenamed("id", "step_ms")

    def covering(self, ts: Column, window: int) -> Column:
        """All steps t with t - window < ts <= t: computed for each row, nothing is joined."""
        first = F.greatest(F.lit(self.start), F.lit(self.start) + N.ceil_div(ts - self.start, self.step) * self.step)
        last = F.least(F.lit(self.last), F.lit(self.start) + N.floor_div(ts + (window - 1) - self.start, self.step) * self.step)
        return F.when(first <= last, F.sequence(first, last, F.lit(self.step))).otherwise(F.array().cast("array<long>"))

    def fan_out(self, df: DataFrame, window: int, ts: str = "ts_ms") -> DataFrame:
        """df, pruned to the time the grid needs, with a row for each step that covers it."""
        near = df.where((F.col(ts) > self.start - window) & (F.col(ts) <= self.last))
        return near.withColumn("step_ms", F.explode(self.covering(F.col(ts), window)))
