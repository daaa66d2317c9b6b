"""The same windows over streams, with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L


def windowed(samples: DataFrame, window: str, slide: str, late: str, names: list[str]) -> DataFrame:
    """Count, sum and maximum of (ts TIMESTAMP, labels, value) for each window and the labels named."""
    rows = samples.withWatermark("ts", late).withColumn("k", F.to_json(F.array_sort(F.map_entries(L.keep(F.col("labels"), names)))))
    return rows.groupBy(F.window("ts", window, slide).alias("w"), "k").agg(F.count("*").alias("n"), F.sum("value").alias("sum"), F.max("value").alias("max")).select(F.col("w.end").alias("end"), "k", "n", "sum", "max")


def distinct(logs: DataFrame, label: str, late: str) -> DataFrame:
    """The first line of each value of a label that comes within the watermark."""
    return logs.withColumn("_v", F.col("labels")[label]).withWatermark("ts", late).dropDuplicatesWithinWatermark(["_v"]).drop("_v")
