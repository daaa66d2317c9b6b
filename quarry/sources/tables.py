"""Canonical tables: partitioned Parquet by day, and the expansions that happen on writing."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import numbers as N

STALE_BITS = 0x7FF0000000000002


def write(df: DataFrame, path: str, by: str = "ts_ns", per_second: int = 10**9, sort: tuple[str, ...] = ()) -> None:
    """Partitioned by day, sorted inside files so that scans can skip row groups."""
    day = F.to_date(F.timestamp_seconds(N.floor_div(F.col(by), per_second)))
    out = df.withColumn("day", day).repartition("day", F.pmod(F.col(by), F.lit(16)))
    out.sortWithinPartitions("day", *sort, by).write.mode("append").partitionBy("day").parquet(path)


def read(spark: SparkSession, path: str, start_s: int | None = None, end_s: int | None = None) -> DataFrame:
    """The table; with bounds (seconds, both included) only the folders of their days are listed and read."""
    df = spark.read.parquet(path)
    for bound, test in ((start_s, ">="), (end_s, "<=")):
        if bound is not None:
            df = df.where(f"day {test} date'{time.strftime('%Y-%m-%d', time.gmtime(bound))}'")
    return df.drop("day")


def with_series(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples (labels, ts_ms, value) as samples (series_id, ts_ms, value) and series (series_id, labels).

    An id is a 64-bit hash of all labels: two series of the same id would be one, at 10^9 series with a chance of 3 %.
    """
    sid = F.xxhash64(L.key(F.col("labels"))).alias("series_id")
    series = samples.select(sid, "labels").groupBy("series_id").agg(F.any_value("labels").alias("labels"))
    return samples.select(sid, *(c for c in samples.columns if c != "labels")), series


def histogram_samples(points: DataFrame) -> DataFrame:
    """Samples of explicit histograms (name, labels, ts_ms, count, sum, min, max, bucket_counts, explicit_bounds)."""
    def one(suffix: str, value) -> DataFrame:
        df = points.withColumn("value", value.cast("double")).where("value is not null")
        return df.select(L.put(F.col("labels"), L.NAME, F.concat("name", F.lit(suffix))).alias("labels"), "ts_ms", "value")

    sums = F.transform(F.sequence(F.lit(1), F.size("bucket_counts")), lambda k: F.aggregate(F.slice("bucket_counts", F.lit(1), k), F.lit(0).cast("long"), lambda a, x: a + x))
    bounds = F.concat(F.transform("explicit_bounds", lambda b: N.text(b)), F.array(F.lit("+Inf")))
    buckets = points.select("name", "labels", "ts_ms", F.explode(F.arrays_zip(bounds.alias("le"), sums.alias("n"))).alias("b"))
    buckets = buckets.select(L.put(L.put(F.col("labels"), L.NAME, F.concat("name", F.lit("_bucket"))), "le", F.col("b.le")).alias("labels"), "ts_ms", F.col("b.n").cast("double").alias("value"))
    out = buckets
    for suffix in ("count", "sum", "min", "max"):
        out = out.unionByName(one(f"_{suffix}", F.col(suffix)))
    return out


def summary_samples(points: DataFrame) -> DataFrame:
    """Samples of summaries (name, labels, ts_ms, count, sum, quantiles ARRAY<STRUCT<quantile, value>>)."""
    q = points.select("name", "labels", "ts_ms", F.explode("quantiles").alias("q"))
    q = q.select(L.put(L.put(F.col("labels"), L.NAME, F.col("name")), "quantile", N.text(F.col("q.quantile"))).alias("labels"), "ts_ms", F.col("q.value").alias("value"))
    rest = [points.select(L.put(F.col("labels"), L.NAME, F.concat("name", F.lit(f"_{s}"))).alias("labels"), "ts_ms", F.col(s).cast("double").alias("value")) for s in ("count", "sum")]
    return q.unionByName(rest[0]).unionByName(rest[1])


def log_labels(logs: DataFrame) -> DataFrame:
    """(ts_ns, line, labels) of records (ts_ns, body, severity_text, trace_id, span_id, attributes, scope, resource)."""
    base = F.create_map(F.lit("trace_id"), F.col("trace_id"), F.lit("span_id"), F.col("span_id"), F.lit("level"), F.upper("severity_text"), F.lit("detected_level"), F.upper("severity_text"))
    made = F.map_filter(base, lambda k, v: F.coalesce(v, F.lit("")) != "")
    for c in ("attributes", "scope", "resource"):
        made = L.merge(made, L.label_names(F.col(c)))
    named = F.when(F.map_contains_key(made, "service_name"), made).otherwise(L.put(made, "service_name", F.lit("unknown_service")))
    return logs.select("ts_ns", F.col("body").alias("line"), named.alias("labels"))


def copy(spark: SparkSession, source: str, target: str, signals: tuple[str, ...] = ("logs", "metrics", "series", "spans", "profiles")) -> dict[str, int]:
    """Backup and restore: the tables of a store, a folder for each signal, rewritten in another; rows of each that was there."""
    done = {}
    for name in signals:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{source}/{name}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            df = spark.read.parquet(f"{source}/{name}")
            df.write.mode("errorifexists").partitionBy(*(["day"] if "day" in df.columns else [])).parquet(f"{target}/{name}")
            done[name] = spark.read.parquet(f"{target}/{name}").count()
    return done


def container_logs(spark: SparkSession, path: str) -> DataFrame:
    """(ts_ns, line, labels) of container log files in JSON lines (log, stream, time), <path>/<container>/*.log.

    Containers are labels; the order of entries is that of a query.
    """
    rows = spark.read.text(f"{path}/*/*.log").select(F.from_json("value", "log string, stream string, time string").alias("r"), F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1).alias("container"))
    at = F.regexp_extract(F.col("r.time"), r"\.(\d+)", 1)
    ns = F.unix_micros(F.date_trunc("second", F.to_timestamp("r.time"))) * 1000 + F.rpad(at, 9, "0").cast("long")
    return rows.where("r.log is not null").select(F.coalesce(ns, F.unix_micros(F.to_timestamp("r.time")) * 1000).alias("ts_ns"), F.rtrim(F.col("r.log"), F.lit("\n")).alias("line"), F.create_map(F.lit("container"), F.col("container"), F.lit("stream"), F.coalesce("r.stream", F.lit("stdout"))).alias("labels"))
