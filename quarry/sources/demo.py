"""The driver's tables as metrics, logs, traces and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import NAME, key
from .tables import log_labels


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(df: DataFrame, by: str) -> DataFrame:
    """df dealt out to all cores by a key, where its files make fewer tasks of half a megabyte or more."""
    plan = df._jdf.queryExecution()
    n = min(df.sparkSession.sparkContext.defaultParallelism, int(str(plan.optimizedPlan().stats().sizeInBytes())) >> 19)
    return df.repartition(n, by) if n > plan.toRdd().getNumPartitions() else df


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    return e.select(F.create_map(F.lit(NAME), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string")).alias("labels"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), "value")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    return e.select((F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"), F.col("props").alias("line"), F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string")).alias("labels"))


def access_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key=value lines of orders, a second apart."""
    o = _dealt(_read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), "o_orderkey")
    line = F.concat(F.lit("status="), F.col("o_orderstatus"), F.lit(" prio=\""), F.col("o_orderpriority"), F.lit("\" cust="), F.col("o_custkey").cast("string"), F.lit(" took="), (F.col("o_orderkey") % 900).cast("string"), F.lit("ms ip=10.0."), (F.col("o_custkey") % 4).cast("string"), F.lit("."), (F.col("o_orderkey") % 250).cast("string"))
    return o.select((F.col("o_orderkey") * 1_000_000_000).alias("ts_ns"), line.alias("line"), F.create_map(F.lit("job"), F.lit("orders"), F.lit("status"), F.col("o_orderstatus")).alias("labels"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a trace, a turn a span below the turn before it."""
    c = _read(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    hex_ = lambda x, n: F.lpad(F.lower(F.hex(x)), n, "0")
    start = F.col("conv_id") * 10**9 + F.col("turn") * 10**6
    turn = F.col("turn").cast("string")
    reply = F.struct((start + F.col("turn") * 1000).alias("ts_ns"), F.lit("reply").alias("name"), F.create_map(F.lit("at"), turn).alias("attributes"))
    back = F.struct(hex_(F.col("conv_id"), 32).alias("trace_id"), hex_(F.lit(1), 16).alias("span_id"), F.create_map(F.lit("kind"), F.lit("root")).alias("attributes"))
    return c.select(
        hex_(F.col("conv_id"), 32).alias("trace_id"), hex_(F.col("turn") + 1, 16).alias("span_id"), F.when(F.col("turn") > 0, hex_(F.col("turn"), 16)).alias("parent_span_id"),
        F.concat(F.lit("turn-"), F.col("role")).alias("name"), F.when(F.col("role") == "user", "client").otherwise("server").alias("kind"), F.when(F.length("text") % 7 == 0, "error").otherwise("ok").alias("status"), F.lit("").alias("status_message"),
        start.alias("start_ns"), (F.length("text").cast("long") * 1000).alias("duration_ns"), F.col("role").alias("service"),
        F.create_map(F.lit("chars"), F.length("text").cast("string"), F.lit("turn"), F.col("turn").cast("string")).alias("attributes"), F.create_map(F.lit("lib"), F.lit("chat")).alias("scope_attributes"), F.create_map(F.lit("service.name"), F.col("role")).alias("resource_attributes"),
        F.when(F.col("role") == "assistant", F.array(reply)).otherwise(F.array().cast("array<struct<ts_ns:bigint,name:string,attributes:map<string,string>>>")).alias("events"),
        F.when(F.col("turn") > 0, F.array(back)).otherwise(F.array().cast("array<struct<trace_id:string,span_id:string,attributes:map<string,string>>>")).alias("links"), F.lit("demo").alias("scope_name"), F.lit("1").alias("scope_version"),
    )


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines from records with a severity and a trace, as ingestion labels them."""
    lines, level = access_logs(spark, sf_dir), F.col("labels")["status"]
    none = F.create_map().cast("map<string,string>")
    trace = F.lpad(F.lower(F.hex(F.regexp_extract("line", "cust=([0-9]+)", 1).cast("long"))), 32, "0")
    severity = F.when(level == "O", "Info").when(level == "F", "Error").otherwise("Warn")
    return log_labels(lines.select("ts_ns", F.col("line").alias("body"), severity.alias("severity_text"), trace.alias("trace_id"), F.lit("").alias("span_id"), none.alias("attributes"), none.alias("scope"), F.create_map(F.lit("service.name"), F.lit("orders")).alias("resource")))


def price_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classic histogram of prices for each return flag, sampled once."""
    bounds = [1000, 10_000, 30_000, 60_000]
    per = _read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*(F.count(F.when(F.col("l_extendedprice") <= b, 1)).alias(str(b)) for b in bounds), F.count("*").alias("+Inf"))
    rows = per.select("l_returnflag", F.explode(F.array(*(F.struct(F.lit(str(b)).alias("le"), F.col(str(b)).cast("double").alias("n")) for b in [*bounds, "+Inf"]))).alias("b"))
    labels = F.create_map(F.lit(NAME), F.lit("price_bucket"), F.lit("flag"), F.col("l_returnflag"), F.lit("le"), F.col("b.le"))
    return rows.select(labels.alias("labels"), F.lit(1_704_153_600_000).alias("ts_ms"), F.col("b.n").alias("value"))


def price_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exponential histogram of prices for each return flag at scale 1 (buckets grow by the root of 2)."""
    k = F.ceil(F.log2("l_extendedprice") * 2).cast("int") - 1
    per = _read(spark, sf_dir, "lineitem").groupBy("l_returnflag", k.alias("k")).agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("s"))
    one = per.groupBy("l_returnflag").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("by"), F.sum("n").alias("count"), F.sum("s").alias("sum"))
    none = F.array().cast("array<bigint>")
    return one.select(
        F.create_map(F.lit(NAME), F.lit("price"), F.lit("flag"), F.col("l_returnflag")).alias("labels"), F.lit(1_704_153_600_000).alias("ts_ms"), "count", F.col("sum").cast("double").alias("sum"), F.lit(1).alias("scale"), F.lit(0).cast("long").alias("zero_count"),
        F.col("lo").alias("positive_offset"), F.transform(F.sequence("lo", "hi"), lambda i: F.coalesce(F.col("by")[i], F.lit(0)).cast("long")).alias("positive_counts"), F.lit(0).alias("negative_offset"), none.alias("negative_counts"),
    )


def metric_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("name"), F.lit("gauge").alias("type"), F.lit("1").alias("unit"), F.concat(F.lit("values of "), "event_type").alias("description"))


def exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth event names a trace; a series is named by its key."""
    e = _read(spark, sf_dir, "events").where("event_id % 10 = 0")
    labels = F.create_map(F.lit(NAME), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"))
    return e.select(key(labels).alias("series"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.lpad(F.lower(F.hex("event_id")), 32, "0").alias("trace_id"), "value")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of a part's type are a stack."""
    p = _read(spark, sf_dir, "part")
    return p.select(F.lit("cpu:cpu:nanoseconds:cpu:nanoseconds").alias("profile_type"), F.create_map(F.lit("service_name"), F.col("p_brand")).alias("labels"), (F.col("p_partkey") * 1_000_000_000).alias("ts_ns"), F.split("p_type", " ").alias("stack"), F.col("p_size").cast("long").alias("value"))


def otlp_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order lines as export requests in JSON, a request a line."""
    kv = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(v.alias("stringValue")).alias("value"))
    rows = access_logs(spark, sf_dir)
    record = F.struct(F.col("ts_ns").cast("string").alias("timeUnixNano"), F.lit(9).alias("severityNumber"), F.struct(F.col("line").alias("stringValue")).alias("body"), F.array(kv("http.status", F.col("labels")["status"])).alias("attributes"))
    scope = F.struct(F.struct(F.lit("demo").alias("name")).alias("scope"), F.array(record).alias("logRecords"))
    top = F.struct(F.struct(F.array(kv("service.name", F.lit("orders"))).alias("attributes")).alias("resource"), F.array(scope).alias("scopeLogs"))
    return rows.select(F.to_json(F.struct(F.array(top).alias("resourceLogs"))).alias("value"))


def otlp_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as gauges in export requests."""
    e = _read(spark, sf_dir, "events")
    kv = lambda k, v, kind="stringValue": F.struct(F.lit(k).alias("key"), F.struct(v.alias(kind)).alias("value"))
    at = (F.unix_millis(F.col("ts").cast("timestamp")) * 10**6).cast("string")
    point = F.struct(F.array(kv("user.id", F.col("user_id").cast("string"), "intValue")).alias("attributes"), at.alias("timeUnixNano"), F.col("value").alias("asDouble"))
    metric = F.struct(F.col("event_type").alias("name"), F.struct(F.array(point).alias("dataPoints")).alias("gauge"))
    scope = F.struct(F.struct(F.lit("demo").alias("name")).alias("scope"), F.array(metric).alias("metrics"))
    top = F.struct(F.struct(F.array(kv("job", F.lit("events"))).alias("attributes")).alias("resource"), F.array(scope).alias("scopeMetrics"))
    return e.select(F.to_json(F.struct(F.array(top).alias("resourceMetrics"))).alias("value"))


def otlp_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root turns and their replies as spans in export requests."""
    c = _read(spark, sf_dir, "conversations")
    kv = lambda k, v, kind="stringValue": F.struct(F.lit(k).alias("key"), F.struct(v.alias(kind)).alias("value"))
    hex_ = lambda x, n: F.lpad(F.upper(F.hex(x)), n, "0")
    start = F.col("conv_id") * 10**9 + F.col("turn") * 10**6
    span = F.struct(hex_("conv_id", 32).alias("traceId"), hex_(F.col("turn") + 1, 16).alias("spanId"), F.when(F.col("turn") > 0, hex_("turn", 16)).otherwise("").alias("parentSpanId"), F.concat(F.lit("turn-"), "role").alias("name"), F.lit(2).alias("kind"), start.cast("string").alias("startTimeUnixNano"), (start + F.length("text") * 1000).cast("string").alias("endTimeUnixNano"), F.array(kv("turn", F.col("turn").cast("string"), "intValue")).alias("attributes"), F.struct(F.lit(1).alias("code")).alias("status"))
    scope = F.struct(F.struct(F.lit("demo").alias("name"), F.lit("1").alias("version")).alias("scope"), F.array(span).alias("spans"))
    top = F.struct(F.struct(F.array(kv("service.name", F.col("role"))).alias("attributes")).alias("resource"), F.array(scope).alias("scopeSpans"))
    return c.where("conv_id is not null and turn is not null").select(F.to_json(F.struct(F.array(top).alias("resourceSpans"))).alias("value"))


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order lines as bodies of records that ask for their format to be found, and the events' JSON in a named format."""
    none = F.create_map().cast("map<string,string>")
    blank = [F.lit("").alias(c) for c in ("severity_text", "trace_id", "span_id")]
    lines = access_logs(spark, sf_dir).select("ts_ns", F.concat(F.lit("level=warn msg=\""), F.col("labels")["status"], F.lit("\" "), "line").alias("body"), *blank, F.create_map(F.lit("log.parse"), F.lit("yes")).alias("attributes"))
    json = logs(spark, sf_dir).select("ts_ns", "line", *blank, F.create_map(F.lit("log.format"), F.lit("generic-json")).alias("attributes")).withColumnRenamed("line", "body")
    return lines.unionByName(json).withColumns({"scope": none, "resource": none})
