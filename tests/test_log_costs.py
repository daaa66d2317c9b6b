"""What a line is parsed into is computed once for a row, however many filters and columns use it."""

import ipaddress

import pytest
from pyspark.sql import functions as F

from quarry import queries
from quarry.operators.logs import LogEngine, ip_matches

SF = "/root/testdata/sf0.001"


def _parses(df) -> int:
    """How often the plan looks for the pairs of a line: twice for keys and values of each pass over the lines."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(line")


def test_duration_filter_parses_once(spark):
    assert _parses(queries.QUERIES["F11_duration"](spark, SF)) == 2


def test_last_of_equal_keys_counts(spark):
    rows = [(1, 'a=1 b="x \\"y\\"" c'), (2, "a=1 a=2 b=3 a="), (3, 'a="1')]
    logs = spark.createDataFrame(rows, "ts_ns long, line string").withColumn("labels", F.create_map(F.lit("j"), F.lit("1"), F.lit("a"), F.lit("0")))
    got = {r.ts_ns: r.labels for r in LogEngine(logs).query_range('{j="1"} | logfmt', 0, 10).collect()}
    assert got[1] == {"j": "1", "a": "1", "b": 'x "y"', "c": ""} and got[2] == {"j": "1", "a": "", "b": "3"}
    assert got[3] == {"j": "1", "a": "0", "__error__": "LogfmtParserErr"}


def test_bytes_filter_parses_once(spark):
    assert _parses(queries.QUERIES["F12_bytes"](spark, SF)) == 2


def test_distinct_parses_once_a_pass(spark):
    """Lines with the label and lines without it are a pass each."""
    assert _parses(queries.QUERIES["F15_distinct"](spark, SF)) == 4


def test_distinct_missing_parses_once_a_pass(spark):
    assert _parses(queries.QUERIES["F15_distinct_missing"](spark, SF)) == 6


def test_distinct_two_parses_once_a_pass(spark):
    assert _parses(queries.QUERIES["F15_distinct_two"](spark, SF)) == 6


def test_unwrap_bytes_parses_once(spark):
    assert _parses(queries.QUERIES["F29_unwrap_bytes"](spark, SF)) == 2


def test_ip6_parses_once(spark):
    assert _parses(queries.QUERIES["F7_ip6"](spark, SF)) == 2


@pytest.mark.parametrize("spec", ["2001:db8::/120", "::1", "2001:db8::1-2001:db8::ff", "::ffff:0:0/96", "::/0"])
def test_ip6_is_as_the_standard_library_reads_it(spark, spec):
    texts = ["2001:db8::1", "2001:DB8:0:0:0:0:0:ff", "2001:db8::100", "2001:db8::10000", "::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8::", "1:2:3:4:5:6:7", "1::2::3", ":::", "1:::2", ":1", "1:", "::ffff:10.0.0.1", "::ffff:10.0.0.256", "1:2:3:4:5:6:10.0.0.1", "10.0.0.1", "10.0.0.01", "fe80::1%eth0", "fe80::1%", "g::1", "", "::1\n", "x"]
    low, high = [int(ipaddress.ip_address(x)) for x in spec.split("-")] if "-" in spec else [int(x) for x in (ipaddress.ip_network(spec)[0], ipaddress.ip_network(spec)[-1])]

    def want(text):
        try:
            ip = ipaddress.ip_address(text)
        except ValueError:
            return None
        return ip.version == 6 and low <= int(ip) <= high

    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", ip_matches(F.col("x"), spec).alias("hit")).collect()
    assert {r.x: r.hit for r in rows} == {x: want(x) for x in texts}


def test_ip6_in_a_line(spark):
    logs = spark.createDataFrame([(1, "from 2001:db8::7 ok", {"j": "1"}), (2, "from 2001:db9::7 ok", {"j": "1"})], "ts_ns long, line string, labels map<string,string>")
    assert [r.ts_ns for r in LogEngine(logs).query_range('{j="1"} |= ip("2001:db8::/32")', 0, 10).collect()] == [1]


def test_error_lines_parses_once(spark):
    assert _parses(queries.QUERIES["L_error_lines"](spark, SF)) == 2
