"""Semantics that the demo tables don't reach."""

import pytest
from pyspark.sql import Row

from quarry.operators.logs import LogEngine
from quarry.operators.profiles import flamebearer
from quarry.operators.prom import PromEngine
from quarry.plans import logql, profileql, promql, traceql
from quarry.plans.lexer import QueryError
from quarry.sources import formats, tables


def _samples(spark, series):
    rows = [(labels, t * 15_000, float(v)) for labels, values in series for t, v in enumerate(values) if v is not None]
    return spark.createDataFrame(rows, "labels map<string,string>, ts_ms long, value double")


def _values(df):
    return sorted((tuple(sorted(r.labels.items())), r.step_ms, round(r.value, 6)) for r in df.collect())


def test_rate_with_reset(spark):
    e = PromEngine(_samples(spark, [({"__name__": "c"}, [0, 10, 20, 5, 15])]))
    assert _values(e.query("increase(c[1m])", 60_000)) == [((), 60_000, pytest.approx(40.0, abs=20))]
    assert _values(e.query("resets(c[1m])", 60_000)) == [((), 60_000, 1.0)]
    assert _values(e.query("irate(c[1m])", 60_000)) == [((), 60_000, round(10 / 15, 6))]


def test_duplicate_match_is_an_error(spark):
    e = PromEngine(_samples(spark, [({"__name__": "a", "x": "1"}, [1]), ({"__name__": "a", "x": "2"}, [2]), ({"__name__": "b"}, [3])]))
    with pytest.raises(Exception, match="duplicate series"):
        e.query("b + on () a", 0).collect()


def test_division_and_nan(spark):
    e = PromEngine(_samples(spark, [({"__name__": "a"}, [0])]))
    assert str(e.query("a / 0", 0).first().value) == "nan"
    assert e.query("1 / (a + 0)", 0).first().value == float("inf")
    assert e.query("max(a / 0 or on (none) a)", 0).count() == 1


def test_histogram_quantile(spark):
    series = [({"__name__": "h_bucket", "le": le}, [n]) for le, n in (("1", 10), ("2", 30), ("+Inf", 40))]
    e = PromEngine(_samples(spark, series))
    assert e.query("histogram_quantile(0.5, h_bucket)", 0).first().value == 1.5
    assert e.query("histogram_quantile(0.9, h_bucket)", 0).first().value == 2.0


def test_at_and_unanchored(spark):
    e = PromEngine(_samples(spark, [({"__name__": "ab"}, [1, 2, 3])]))
    assert e.query('{__name__=~"a"}', 30_000).count() == 0
    assert [r.value for r in e.query_range("ab @ 15", 0, 30_000, 15_000).collect()] == [2.0] * 3


def test_label_filter_errors_are_kept(spark):
    rows = [Row(ts_ns=1, line="a=x", labels={"j": "1"}), Row(ts_ns=2, line="a=7", labels={"j": "1"}), Row(ts_ns=3, line="b=7", labels={"j": "1"})]
    e = LogEngine(spark.createDataFrame(rows, "ts_ns long, line string, labels map<string,string>"))
    got = {r.ts_ns: r.labels for r in e.query_range('{j="1"} | logfmt | a > 5', 0, 10).collect()}
    assert set(got) == {1, 2} and got[1]["__error__"] == "LabelFilterError" and "__error__" not in got[2]


def test_pattern_keeps_what_it_bound(spark):
    e = LogEngine(spark.createDataFrame([(1, "GET /x oops", {"j": "1"})], "ts_ns long, line string, labels map<string,string>"))
    labels = e.query_range('{j="1"} | pattern "<m> <p> <c> end"', 0, 10).first().labels
    assert labels["m"] == "GET" and labels["p"] == "/x" and "c" not in labels


def test_formats(spark):
    lines = ['{"msg":"hi","level":"warn","ts":"1700000000","k":"v"}', 'level=info msg="a b" k=1', 'E0223 01:22:17.141045    1386 file.go:197] "boom" err="x"', "2024-01-01T00:00:00Z\tINFO\tmain\tapp.go:1\tstarted\t{\"a\": \"b\"}", "plain"]
    rows = {r.line: r for r in formats.parse(spark.createDataFrame([(x,) for x in lines], "line string")).collect()}
    got = [(rows[x].format, rows[x].body, rows[x].severity_text) for x in lines]
    assert got == [("generic-json", "hi", "WARN"), ("logfmt", "a b", "INFO"), ("klog", "boom", "ERROR"), ("zap-development", "started", "INFO"), (None, "plain", None)]
    assert rows[lines[0]].parsed_ts_ns == 1_700_000_000 * 10**9


def test_histogram_expansion(spark):
    points = spark.createDataFrame([("h", {"a": "b"}, 1, 6, 2.5, None, 1.0, [1, 2, 3], [0.5, 1.0])], "name string, labels map<string,string>, ts_ms long, count long, sum double, min double, max double, bucket_counts array<long>, explicit_bounds array<double>")
    got = {(r.labels["__name__"], r.labels.get("le")): r.value for r in tables.histogram_samples(points).collect()}
    assert got == {("h_bucket", "0.5"): 1, ("h_bucket", "1"): 3, ("h_bucket", "+Inf"): 6, ("h_count", None): 6, ("h_sum", None): 2.5, ("h_max", None): 1.0}


def test_flamebearer():
    names, levels = flamebearer([("", 0, 0, 10), ("a", 1, 4, 7), ("b", 1, 3, 3), ("a\x1fc", 2, 3, 3)])
    assert names == ["total", "a", "c", "b"]
    assert levels == [[0, 10, 0, 0], [0, 7, 4, 1, 0, 3, 3, 3], [4, 3, 3, 2]]


@pytest.mark.parametrize("parse,bad", [(promql.parse, "sum("), (promql.parse, "rate(a[5m]"), (logql.parse, "topk(0, rate({a=\"b\"}[1m]))"), (logql.parse, "sum_over_time({a=\"b\"}[1m])"), (traceql.parse, "{ .a = "), (traceql.parse, "{ } | topk(2)"), (traceql.parse, "{ } | rate() | topk(0)"), (traceql.parse, "{ } | rate() > name"), (profileql.parse, "a:b{}")])
def test_errors(parse, bad):
    with pytest.raises(QueryError):
        parse(bad)
