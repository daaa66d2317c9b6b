"""Metadata: label names and values, series, detected fields, volumes, exemplars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from .logs import LogEngine


def _matching(df: DataFrame, sets: list[list[tuple[str, str, str]]]) -> DataFrame:
    if not sets:
        return df
    cond = F.lit(False)
    for tests in sets:
        one = F.lit(True)
        for name, op, text in tests:
            one &= L.match(L.get(F.col("labels"), name), op, text)
        cond |= one
    return df.where(cond)


def label_names(df: DataFrame, sets: list = ()) -> DataFrame:
    return _matching(df, list(sets)).select(F.explode(F.map_keys("labels")).alias("name")).distinct()


def label_values(df: DataFrame, name: str, sets: list = ()) -> DataFrame:
    return _matching(df, list(sets)).select(F.col("labels")[name].alias("value")).where("value is not null").distinct()


def series(df: DataFrame, sets: list = ()) -> DataFrame:
    return _matching(df, list(sets)).groupBy("labels").agg(F.lit(1).alias("_")).select("labels")


def detected_labels(df: DataFrame) -> DataFrame:
    """Labels with approximate cardinality."""
    return df.select(F.explode("labels").alias("name", "value")).groupBy("name").agg(F.approx_count_distinct("value").alias("cardinality"))


def detected_fields(df: DataFrame) -> DataFrame:
    """Fields of JSON lines with approximate cardinality; types are strings."""
    found = df.select(F.explode(F.from_json("line", "map<string,string>")).alias("name", "value"))
    return found.groupBy("name").agg(F.approx_count_distinct("value").alias("cardinality"), F.lit("string").alias("type"))


def field_values(df: DataFrame, name: str) -> DataFrame:
    """Distinct values of a field of JSON lines."""
    return df.select(F.get_json_object("line", f"$.{name}").alias("value")).where("value is not null").distinct()


def volume(logs: DataFrame, query: str, start_ns: int, end_ns: int, targets: list[str]) -> DataFrame:
    """Lines of a selector over the whole range by labels: (labels, step_ms, value) at its end."""
    span = (end_ns - start_ns) // 10**6
    return LogEngine(logs).query(f"sum by ({', '.join(targets)}) (count_over_time({query}[{span}ms]))", end_ns)


def volume_range(logs: DataFrame, query: str, start_ns: int, end_ns: int, step_ms: int, targets: list[str]) -> DataFrame:
    """The same for each step."""
    return LogEngine(logs).query_range(f"sum by ({', '.join(targets)}) (count_over_time({query}[{step_ms}ms]))", start_ns, end_ns, step_ms)


def stream_costs(logs: DataFrame) -> DataFrame:
    """Entries and bytes of lines of each stream."""
    return logs.groupBy("labels").agg(F.count("*").alias("entries"), F.sum(F.octet_length("line")).cast("long").alias("bytes"))


def metadata(df: DataFrame) -> DataFrame:
    """Type, unit and help of each metric name."""
    return df.groupBy("name").agg(F.last("type", True).alias("type"), F.last("unit", True).alias("unit"), F.last("description", True).alias("help"))


def exemplars(df: DataFrame, samples: DataFrame, sets: list, start_ms: int, end_ms: int) -> DataFrame:
    """Exemplars (series: a label key, ts_ms, trace_id, value) of the series that the samples have, with their labels."""
    known = series(samples, sets).withColumn("series", L.key(F.col("labels")))
    return df.where(F.col("ts_ms").between(start_ms, end_ms)).join(known, "series")
