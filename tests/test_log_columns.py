"""Where only some labels are asked for, they are columns: same results as by the map, and only what is asked for is made."""

import pytest
from pyspark.sql import functions as F

from quarry import queries
from quarry.operators.logs import LogEngine

SF = "/root/testdata/sf0.001"
LINES = ['a=1 b="x \\"y\\"" c', "a=1 a=2 b=3 a=", 'a="1', 'b="a=7 c=8" a=9', "aa=1 ba=2 a.b=3", "a==1 c", "", None, 'a="" b=5KiB', "=a b= c=x=y", 'c="\\\\" a=3', "a=5\nc=6", "x", 'a"b"c', "a=é b=5ms", "b=0.5KiB a=2", 'a="\\"" x', "c a c=1 c"]
QUERIES = [
    "| logfmt", '| logfmt z="a", c="a.b"', "| logfmt | a > 1", '| logfmt | b > 1KB or a = "1"', '| logfmt | label_format c="{{.a}}-{{.b}}", z=j', "| logfmt | label_format j=a, a=b", '| logfmt | drop a="1", j', "| logfmt | keep a, c",
    "| logfmt | distinct a", "| logfmt | distinct c, a", '|= "a" | logfmt | drop b | a >= 0', "| logfmt | label_format c=nothing | c=\"\"", '| logfmt | label_format b="{{ add .a 1 }} of . {{.c}}"',
]


@pytest.fixture(scope="module")
def engine(spark):
    rows = [(k, x, {"j": "1", "a": "0"} if k % 3 else {"j": "1", "c": "s"}) for k, x in enumerate(LINES)]
    return LogEngine(spark.createDataFrame(rows, "ts_ns long, line string, labels map<string,string>"))


@pytest.mark.parametrize("stages", QUERIES)
def test_columns_are_as_the_map(engine, stages):
    names = ("a", "b", "c", "j", "z", "__error__")
    query = '{j="1"} ' + stages
    by_map = engine.query_range(query, 0, 100).select("ts_ns", "line", *(F.coalesce(F.col("labels")[n], F.lit("")).alias(n) for n in names))
    assert sorted(map(str, engine.lines(query, 0, 100, names).collect())) == sorted(map(str, by_map.collect()))


def test_a_long_quoted_value(spark):
    line = 'a="' + "x y " * 20_000 + '\\"\\"" b=1 ' + "k=v " * 20_000 + "b=2"
    logs = spark.createDataFrame([(1, line, {"j": "1"}), (2, line.replace("\\", "/").replace('/"', "/"), {"j": "1"})], "ts_ns long, line string, labels map<string,string>")
    e = LogEngine(logs)
    assert [r.b for r in e.lines('{j="1"} | logfmt', 0, 9, ("b",)).collect()] == ["2", "2"]
    assert [r.labels["b"] for r in e.query_range('{j="1"} | logfmt', 0, 9).collect()] == ["2", "2"]


def _plan(key: str, spark) -> str:
    return queries.QUERIES[key](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_bytes_filter_makes_no_map(spark):
    assert "map_concat" not in _plan("F12_bytes", spark)


@pytest.mark.parametrize("key", ["F15_distinct", "F15_distinct_missing", "F15_distinct_two"])
def test_distinct_sorts_no_lines(spark, key):
    plan = _plan(key, spark)
    assert "ObjectHashAggregate" in plan and "SortAggregate" not in plan and "map_concat" not in plan


@pytest.mark.parametrize("key", ["F29_unwrap_bytes", "L_error_lines"])
def test_sums_are_taken_at_once(spark, key):
    """Not by groups of all labels first, whose maps are sorted to be compared."""
    plan = _plan(key, spark).split("HashAggregate")[-1]
    assert "map_concat" not in plan and "mapsort" not in plan


def test_sum_of_sums_has_no_unwrapped_label(engine):
    """As by the map: the label that is unwrapped is on no sample, others are."""
    got = lambda by: sorted((tuple(sorted(r.labels.items())), r.value) for r in engine.query('sum by (%s) (sum_over_time({j="1"} | logfmt | b = "" | unwrap a [1h]))' % by, 60_000 * 10**6).collect())
    total = sum(v for _, v in got("j"))
    assert got("a") == [((), total)] and got("a, j") == got("j") and [dict(k).get("__error__", "") for k, _ in got("j, __error__")] == ["LogfmtParserErr", "SampleExtractionErr", ""]
