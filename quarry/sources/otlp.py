"""OTLP in JSON, an export request a line, to the canonical tables; all of it is column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import numbers as N

_ANY = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>"
_KV = f"array<struct<key:string,value:{_ANY}>>"
_SCOPE = f"scope:struct<name:string,version:string,attributes:{_KV}>"
_RECORD = f"struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:int,severityText:string,body:{_ANY},attributes:{_KV},traceId:string,spanId:string>"
_SPAN = f"struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:int,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_KV},events:array<struct<timeUnixNano:string,name:string,attributes:{_KV}>>,links:array<struct<traceId:string,spanId:string,attributes:{_KV}>>,status:struct<code:int,message:string>>"
_NUMBER = f"array<struct<attributes:{_KV},timeUnixNano:string,asDouble:double,asInt:string>>"
_BUCKETS = "struct<offset:int,bucketCounts:array<string>>"
_METRIC = f"struct<name:string,description:string,unit:string,gauge:struct<dataPoints:{_NUMBER}>,sum:struct<dataPoints:{_NUMBER},isMonotonic:boolean>,histogram:struct<dataPoints:array<struct<attributes:{_KV},timeUnixNano:string,count:string,sum:double,min:double,max:double,bucketCounts:array<string>,explicitBounds:array<double>>>>,exponentialHistogram:struct<dataPoints:array<struct<attributes:{_KV},timeUnixNano:string,count:string,sum:double,scale:int,zeroCount:string,positive:{_BUCKETS},negative:{_BUCKETS}>>>,summary:struct<dataPoints:array<struct<attributes:{_KV},timeUnixNano:string,count:string,sum:double,quantileValues:array<struct<quantile:double,value:double>>>>>>"
#: Names of the kinds of spans and of their status, by number.
KINDS = ("unspecified", "internal", "server", "client", "producer", "consumer")
STATUS = ("unset", "ok", "error")


def _text(v: Column) -> Column:
    """A value as text; numbers as label values are written."""
    return F.coalesce(v["stringValue"], v["intValue"], N.text(v["doubleValue"]), v["boolValue"].cast("string"), F.lit(""))


def _map(kv: Column) -> Column:
    """The last of equal keys counts."""
    keys = F.array_distinct(F.transform(kv, lambda e: e["key"]))
    return F.coalesce(F.map_from_arrays(keys, F.transform(keys, lambda k: _text(F.element_at(F.filter(kv, lambda e: e["key"] == k), -1)["value"]))), L.empty())


def _items(requests: DataFrame, top: str, scopes: str, items: str, schema: str) -> DataFrame:
    """(resource MAP, scope struct, item) of each record of requests (value: a JSON line)."""
    whole = F.from_json("value", f"{top} array<struct<resource:struct<attributes:{_KV}>,{scopes}:array<struct<{_SCOPE},{items}:array<{schema}>>>>>")
    by_resource = requests.select(F.explode(whole[top]).alias("r"))
    by_scope = by_resource.select(_map(F.col("r.resource.attributes")).alias("resource"), F.explode(f"r.{scopes}").alias("s"))
    return by_scope.select("resource", F.col("s.scope").alias("scope"), F.explode(f"s.{items}").alias("i"))


def logs(requests: DataFrame) -> DataFrame:
    """Records (ts_ns, body, severity_text, trace_id, span_id, attributes, scope, resource); a missing time is the time of observation."""
    i = F.col("i")
    at = F.coalesce(F.nullif(i["timeUnixNano"].cast("long"), F.lit(0)), i["observedTimeUnixNano"].cast("long"), F.lit(0))
    number = i["severityNumber"]
    names = F.array(*map(F.lit, ("Trace", "Debug", "Info", "Warn", "Error", "Fatal")))
    severity = F.coalesce(F.nullif(i["severityText"], F.lit("")), F.when(number.between(1, 24), F.get(names, F.floor((number - 1) / 4).cast("int"))), F.lit(""))
    return _items(requests, "resourceLogs", "scopeLogs", "logRecords", _RECORD).select(
        at.alias("ts_ns"), _text(i["body"]).alias("body"), severity.alias("severity_text"), F.lower(F.coalesce(i["traceId"], F.lit(""))).alias("trace_id"), F.lower(F.coalesce(i["spanId"], F.lit(""))).alias("span_id"),
        _map(i["attributes"]).alias("attributes"), _map(F.col("scope.attributes")).alias("scope"), "resource",
    )


def spans(requests: DataFrame) -> DataFrame:
    i = F.col("i")
    start = i["startTimeUnixNano"].cast("long")
    parent = F.nullif(F.lower(i["parentSpanId"]), F.lit(""))
    named = lambda names, n: F.get(F.array(*map(F.lit, names)), F.coalesce(n, F.lit(0)))
    return _items(requests, "resourceSpans", "scopeSpans", "spans", _SPAN).select(
        F.lower(i["traceId"]).alias("trace_id"), F.lower(i["spanId"]).alias("span_id"), parent.alias("parent_span_id"), i["name"].alias("name"), named(KINDS, i["kind"]).alias("kind"), named(STATUS, i["status"]["code"]).alias("status"),
        F.coalesce(i["status"]["message"], F.lit("")).alias("status_message"), start.alias("start_ns"), (i["endTimeUnixNano"].cast("long") - start).alias("duration_ns"), F.col("resource")["service.name"].alias("service"),
        _map(i["attributes"]).alias("attributes"), _map(F.col("scope.attributes")).alias("scope_attributes"), F.col("resource").alias("resource_attributes"),
        F.transform(F.coalesce(i["events"], F.array()), lambda e: F.struct(e["timeUnixNano"].cast("long").alias("ts_ns"), e["name"].alias("name"), _map(e["attributes"]).alias("attributes"))).alias("events"),
        F.transform(F.coalesce(i["links"], F.array()), lambda e: F.struct(F.lower(e["traceId"]).alias("trace_id"), F.lower(e["spanId"]).alias("span_id"), _map(e["attributes"]).alias("attributes"))).alias("links"),
        F.col("scope.name").alias("scope_name"), F.col("scope.version").alias("scope_version"),
    )


def _points(requests: DataFrame, kind: str) -> DataFrame:
    """(name, labels, ts_ms, p) of the data points of a kind; resource attributes are labels too."""
    items = _items(requests, "resourceMetrics", "scopeMetrics", "metrics", _METRIC)
    rows = items.select("resource", F.col("i.name").alias("name"), F.explode(f"i.{kind}.dataPoints").alias("p"))
    labels = L.label_names(L.merge(F.col("resource"), _map(F.col("p.attributes"))))
    return rows.select("name", labels.alias("labels"), N.floor_div(F.col("p.timeUnixNano").cast("long"), 10**6).alias("ts_ms"), "p")


def samples(requests: DataFrame) -> DataFrame:
    """Samples (labels, ts_ms, value) of gauges and sums."""
    both = _points(requests, "gauge").unionByName(_points(requests, "sum"))
    return both.select(L.put(F.col("labels"), L.NAME, F.col("name")).alias("labels"), "ts_ms", F.coalesce(F.col("p.asDouble"), F.col("p.asInt").cast("double")).alias("value"))


def histogram_points(requests: DataFrame) -> DataFrame:
    """What ``tables.histogram_samples`` takes."""
    return _points(requests, "histogram").select("name", "labels", "ts_ms", F.col("p.count").cast("long").alias("count"), "p.sum", "p.min", "p.max", F.col("p.bucketCounts").cast("array<bigint>").alias("bucket_counts"), F.col("p.explicitBounds").alias("explicit_bounds"))


def summary_points(requests: DataFrame) -> DataFrame:
    """What ``tables.summary_samples`` takes."""
    return _points(requests, "summary").select("name", "labels", "ts_ms", F.col("p.count").cast("long").alias("count"), "p.sum", F.col("p.quantileValues").alias("quantiles"))


def native_histograms(requests: DataFrame) -> DataFrame:
    """What ``PromEngine`` takes as histograms."""
    side = lambda x: (F.coalesce(F.col(f"p.{x}.offset"), F.lit(0)).alias(f"{x}_offset"), F.coalesce(F.col(f"p.{x}.bucketCounts").cast("array<bigint>"), F.array().cast("array<bigint>")).alias(f"{x}_counts"))
    labels = L.put(F.col("labels"), L.NAME, F.col("name")).alias("labels")
    return _points(requests, "exponentialHistogram").select(labels, "ts_ms", F.col("p.count").cast("long").alias("count"), "p.sum", "p.scale", F.coalesce(F.col("p.zeroCount").cast("long"), F.lit(0)).alias("zero_count"), *side("positive"), *side("negative"))
