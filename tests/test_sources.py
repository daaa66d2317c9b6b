"""Sources and sinks: wire formats, stores, container logs, records with formats, streams."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from quarry.sources import formats, otlp, remote_write, safety, tables
from quarry.streaming import live


@pytest.mark.parametrize("version", [1, 2])
def test_remote_write(spark, version):
    rows = [({"__name__": "a", "x": "é"}, -5, 1.5), ({"__name__": "a", "x": "é"}, 1 << 45, float("inf")), ({"__name__": "b"}, 0, -0.0)]
    frame = spark.createDataFrame(rows, "labels map<string,string>, ts_ms long, value double")
    got = remote_write.read(remote_write.write(frame, version, 2)).collect()
    assert sorted((sorted(r.labels.items()), r.ts_ms, r.value) for r in got) == sorted((sorted(a.items()), t, v) for a, t, v in rows)


def test_remote_write_passes_over_fields():
    sample = b"\x09" + struct.pack("<d", 2.0) + b"\x10\x07"
    label = remote_write._bytes(1, b"k") + remote_write._bytes(2, b"v")
    body = remote_write._bytes(1, remote_write._bytes(1, label) + remote_write._bytes(3, b"exemplar") + b"\x2d\0\0\0\0" + remote_write._bytes(2, sample)) + remote_write._bytes(3, b"metadata")
    assert list(remote_write.series(body)) == [({"k": "v"}, [(7, 2.0)])]
    assert remote_write.decompress(remote_write.encode([])) == b""
    with pytest.raises(ValueError):
        list(remote_write.fields(b"\x0a\x05ab"))


def test_otlp_metrics(spark):
    kv = lambda k, v: {"key": k, "value": v}
    at = {"timeUnixNano": "1700000000000000000"}
    metrics = [
        {"name": "g", "gauge": {"dataPoints": [at | {"asInt": "7", "attributes": [kv("a.b", {"boolValue": True})]}]}},
        {"name": "h", "histogram": {"dataPoints": [at | {"count": "3", "sum": 4.0, "bucketCounts": ["1", "2"], "explicitBounds": [1.5]}]}},
        {"name": "e", "exponentialHistogram": {"dataPoints": [at | {"count": "5", "sum": 9.0, "scale": 0, "zeroCount": "1", "positive": {"offset": 1, "bucketCounts": ["4"]}}]}},
        {"name": "s", "summary": {"dataPoints": [at | {"count": "2", "sum": 3.0, "quantileValues": [{"quantile": 0.5, "value": 1.0}]}]}},
    ]
    line = json.dumps({"resourceMetrics": [{"resource": {"attributes": [kv("job", {"stringValue": "j"})]}, "scopeMetrics": [{"metrics": metrics}]}]})
    requests = spark.createDataFrame([(line,), ("{}",), ("broken",)], "value string")
    assert [(r.labels, r.ts_ms, r.value) for r in otlp.samples(requests).collect()] == [({"__name__": "g", "a_b": "true", "job": "j"}, 1_700_000_000_000, 7.0)]
    classic = {r.labels.get("le"): r.value for r in tables.histogram_samples(otlp.histogram_points(requests)).collect() if "le" in r.labels}
    assert classic == {"1.5": 1, "+Inf": 3}
    h = otlp.native_histograms(requests).first()
    assert (h["labels"]["__name__"], h["count"], h["scale"], h["zero_count"], h["positive_offset"], h["positive_counts"], h["negative_counts"]) == ("e", 5, 0, 1, 1, [4], [])
    assert {r.labels.get("quantile"): r.value for r in tables.summary_samples(otlp.summary_points(requests)).collect()} == {"0.5": 1.0, None: 3.0} or tables.summary_samples(otlp.summary_points(requests)).count() == 3


def test_consumer(spark):
    none = {}
    rows = [
        (5, '{"msg":"hi","lvl":"error","ts":"1700000000","trace_id":"' + "AB" * 16 + '","k":"v"}', "Info", "", "", {"log.format": "generic-json"}, none, none),
        (6, "level=info a=1", "", "", "", {"log.parse": "x"}, none, none),
        (7, "level=info a=1", "Warn", "", "", none, none, none),
        (8, "level=info a=1", "Warn", "", "", {"log.format": "klog"}, none, none),
    ]
    frame = spark.createDataFrame(rows, "ts_ns long, body string, severity_text string, trace_id string, span_id string, attributes map<string,string>, scope map<string,string>, resource map<string,string>")
    got = sorted(formats.consume(frame).collect(), key=lambda r: r.ts_ns)
    assert [(r.ts_ns, r.body, r.severity_text, r.trace_id) for r in got] == [(6, "", "INFO", ""), (7, "level=info a=1", "Warn", ""), (8, "level=info a=1", "Warn", ""), (1_700_000_000 * 10**9, "hi", "ERROR", "ab" * 16)]
    assert got[3].attributes == {"log.format": "generic-json", "k": "v"} and got[0].attributes == {"log.parse": "x", "a": "1"} and got[2].attributes == {"log.format": "klog"}


def test_store(spark, tmp_path):
    """Days are folders: a read between times lists only theirs; a copy has all rows."""
    rows = spark.range(40).select((F.col("id") * 3600 * 10**9 * 6).alias("ts_ns"), F.col("id").cast("string").alias("line"))
    tables.write(rows, f"{tmp_path}/a/logs", sort=("line",))
    part = tables.read(spark, f"{tmp_path}/a/logs", 86_400, 2 * 86_400 - 1)
    assert sorted(int(r.line) for r in part.collect()) == [4, 5, 6, 7]
    assert "PartitionFilters: [isnotnull(day" in part._jdf.queryExecution().explainString(part._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert tables.copy(spark, f"{tmp_path}/a", f"{tmp_path}/b") == {"logs": 40}
    assert sorted(map(tuple, tables.read(spark, f"{tmp_path}/b/logs").collect())) == sorted(map(tuple, rows.collect()))


def test_series_table(spark):
    frame = spark.createDataFrame([({"a": "1", "b": "2"}, 1, 1.0), ({"b": "2", "a": "1"}, 2, 2.0), ({"a": "1"}, 2, 2.0)], "labels map<string,string>, ts_ms long, value double")
    samples, series = tables.with_series(frame)
    assert samples.columns == ["series_id", "ts_ms", "value"] and series.count() == 2 and samples.join(series, "series_id").count() == 3


def test_container_logs(spark, tmp_path):
    folder = tmp_path / "web"
    folder.mkdir()
    (folder / "x.log").write_text('{"log":"hello\\n","stream":"stderr","time":"2024-01-01T00:00:01.123456789Z"}\n{"log":"b","time":"2024-01-01T00:00:02Z"}\nbroken\n')
    got = sorted(tables.container_logs(spark, str(tmp_path)).collect(), key=lambda r: r.ts_ns)
    assert [(r.ts_ns - 1_704_067_200 * 10**9, r.line, r.labels) for r in got] == [(1_123_456_789, "hello", {"container": "web", "stream": "stderr"}), (2_000_000_000, "b", {"container": "web", "stream": "stdout"})]


def test_guard(spark):
    rows = [(k // 4 * 10**9 + k, f"m{k % 2}", {"n": str(k)} | ({"passthrough": "true"} if k == 3 else {})) for k in range(12)]
    logs = spark.createDataFrame(rows, "ts_ns long, line string, labels map<string,string>")
    run = lambda **x: sorted((r.ts_ns % 10**9, r.line) for r in safety.guard(logs, safety.Limits(**x)).collect())
    assert len(run()) == 12 and [t for t, _ in run(soft=1, on_excess="drop")] == [0, 3, 4, 8]
    assert run(soft=1, on_excess="truncate") == [(0, "m0"), (1, "8 suppressed"), (3, "m1"), (4, "m0"), (8, "m0")]
    assert [t for t, _ in run(soft=1, hard=2, on_excess="sample", sample_first=9)] == [0, 1, 3, 4, 5, 8, 9]
    assert safety.redact(logs, ["n"]).first()["labels"]["n"] == "<redacted>"
    with pytest.raises(ValueError):
        safety.guard(logs, safety.Limits(1, on_excess="lose"))


def test_streams(spark, tmp_path):
    """Windows and distinct values over a file stream come out as over a table."""
    rows = [(k, "ab"[k % 2], float(k)) for k in range(20)]
    frame = spark.createDataFrame(rows, "s long, n string, value double").select(F.timestamp_seconds("s").alias("ts"), F.create_map(F.lit("n"), F.col("n")).alias("labels"), "value")
    frame.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")
    for name, df in (("windows", live.windowed(stream, "10 seconds", "5 seconds", "1 minute", ["n"])), ("firsts", live.distinct(stream, "n", "1 minute"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete" if name == "windows" else "append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    got = {(r.end.timestamp(), json.loads(r.k)[0]["value"]): (r.n, r.sum, r.max) for r in spark.table("windows").collect()}
    assert got[10.0, "a"] == (5, 20.0, 8.0) and got[15.0, "b"] == (5, 45.0, 13.0) and len(got) == 10
    assert spark.table("firsts").count() == 2
