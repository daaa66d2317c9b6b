"""Lines are parsed by compiled code, on all cores; the short ways give what the long ones do."""

import pytest
from pyspark.sql import functions as F

from quarry import queries
from quarry.functions import numbers as N
from quarry.operators.logs import LogEngine

SF = "/root/testdata/sf0.1"
LINES = ["a=1", " a=1", "\ta=1", "\x0ba=1", " a=1", "x=a", "x= a", "=a=2", "aa=1 a=2", "xa=1", "a", "a b", "a=", 'a="', 'a="x', 'a="x y" b=1', 'b="a=1"', 'b=" a=1" c', 'b="" a=1', 'b"a=1"', 'b" a=1 "', '" a=1 "', "b=1 a=x=y", 'a=x"y', 'a"=1"', "é a=é b=ü", "a=1\na", "b.a=1 c", "c=1\r\na=2", 'c="1" b=a']


def _plan(key: str, spark) -> str:
    return queries.QUERIES[key](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("names", [("a",), ("b", "c", "__error__"), ("a", "b", "c", "j")])
def test_short_ways_are_as_the_map(spark, names):
    rows = [(k, x, {"j": "1", "a": "0"} if k % 2 else {"j": "1"}) for k, x in enumerate(LINES)]
    e = LogEngine(spark.createDataFrame(rows, "ts_ns long, line string, labels map<string,string>"))
    by_map = e.query_range('{j="1"} | logfmt', 0, 100).select("ts_ns", "line", *(F.coalesce(F.col("labels")[n], F.lit("")).alias(n) for n in names))
    assert sorted(map(str, e.lines('{j="1"} | logfmt', 0, 100, names).collect())) == sorted(map(str, by_map.collect()))


def test_distinct_missing_is_compiled_and_dealt_out(spark):
    plan = _plan("F15_distinct_missing", spark)
    assert "lambda" not in plan and "REPARTITION_BY_NUM" in plan


def test_distinct_two_holds_each_row_once(spark):
    """Not as the row and as what it is ordered by; both passes read lines that were dealt out once."""
    plan = _plan("F15_distinct_two", spark)
    assert "min(struct(" in plan and "min_by" not in plan and "lambda" not in plan and "REPARTITION_BY_NUM" in plan


def test_doubles_are_as_cast(spark):
    texts = ["1", " 1 ", "\t-1.5e3\n", "+.5", "1.", ".", "", " ", "-", "1d", "1F", "1L", "0x1.8p3", "0X1P-2", "0x", "1e", "1e+5", "1 2", "NaN", "nan", "-nan", "inf", "+INF", "-Infinity", " infinity ", "infinit", "1-URGENT", "5ms", "1_0", "1,0", "\u0661", "e5", "1\x00", "\x7f1", "1\u00a0", "--1", "1e999"]
    rows = spark.createDataFrame([(x,) for x in [*texts, None]], "x string").select("x", N.double_column(F.col("x")).alias("a"), F.col("x").try_cast("double").alias("b")).collect()
    assert [r.x for r in rows if str(r.a) != str(r.b)] == []


def test_error_lines_throws_for_no_line(spark):
    """A cast that fails throws; what can't be a number isn't cast."""
    assert "RLIKE" in _plan("L_error_lines", spark).split("try_cast")[0].rsplit("Generate", 1)[-1]
