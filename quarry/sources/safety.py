"""A guard on the rate of records: what exceeds a soft or hard limit is dropped, sampled, compacted or truncated."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import numbers as N

#: The label by which a record passes through, unless another is named.
PASS = "passthrough"
MODES = ("consume", "drop", "sample", "compact", "truncate")


@dataclass(frozen=True)
class Limits:
    """Records a period that pass, and what happens to those above; 0 is no limit."""

    soft: int = 0
    hard: int = 0
    on_excess: str = "consume"
    on_hard_excess: str = "drop"
    period_ns: int = 10**9
    sample_first: int = 100
    sample_thereafter: int = 100
    window_ns: int = 30 * 10**9
    compact_threshold: int = 100
    passthrough: str = PASS


def guard(logs: DataFrame, limits: Limits) -> DataFrame:
    """(ts_ns, line, labels): what passes, and a record for each window (and line, if compacted) of what was held back.

    The n-th record of a period, in the order of time and line, is beyond a limit if n is; records that pass through
    by label are not counted. A synthetic record has the time of the window's first suppressed record.
    """
    if {limits.on_excess, limits.on_hard_excess} - set(MODES):
        raise ValueError(f"modes are {', '.join(MODES)}")
    free = F.coalesce(F.lower(F.col("labels")[limits.passthrough]) == "true", F.lit(False))
    rows = logs.where(~free).withColumns({"period": N.floor_div(F.col("ts_ns"), limits.period_ns), "window": N.floor_div(F.col("ts_ns"), limits.window_ns)})
    order = ("ts_ns", "line", L.key(F.col("labels")))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("period").orderBy(*order)))
    over: Column = F.lit("consume")
    for limit, mode in ((limits.soft, limits.on_excess), (limits.hard, limits.on_hard_excess)):
        if limit:
            over = F.when(F.col("nth") > limit, mode).otherwise(over)
    rows = rows.withColumn("mode", over)
    beyond = F.col("nth") - F.when(F.col("mode") == limits.on_hard_excess, limits.hard if limits.hard else limits.soft).otherwise(limits.soft)
    sampled = (F.col("mode") == "sample") & ((beyond <= limits.sample_first) | (beyond % max(1, limits.sample_thereafter) == 0))
    repeat = F.row_number().over(Window.partitionBy("mode", "window", "line").orderBy(*order))
    rows = rows.withColumn("repeat", F.when(F.col("mode") == "compact", repeat))
    few = (F.col("mode") == "compact") & (F.col("repeat") < limits.compact_threshold)
    passed = (F.col("mode") == "consume") | sampled | few
    held = rows.where(~passed & F.col("mode").isin("compact", "truncate")).groupBy("mode", "window", F.when(F.col("mode") == "compact", F.col("line")).alias("line")).agg(F.count("*").alias("n"), F.min("ts_ns").alias("ts_ns"), F.min_by("labels", F.struct(*order)).alias("labels"))
    said = F.concat(F.col("n").cast("string"), F.when(F.col("mode") == "compact", F.concat(F.lit(" collapsed: "), F.col("line"))).otherwise(" suppressed"))
    out = [rows.where(passed), held.withColumn("line", said), logs.where(free)]
    return out[0].select("ts_ns", "line", "labels").unionByName(out[1].select("ts_ns", "line", "labels")).unionByName(out[2].select("ts_ns", "line", "labels"))


def redact(logs: DataFrame, names: list[str]) -> DataFrame:
    """Values of the labels named are hidden."""
    return logs.withColumn("labels", F.transform_values("labels", lambda k, v: F.when(k.isin(names), "<redacted>").otherwise(v)))
