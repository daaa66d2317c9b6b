"""Windows at their bounds, both ways of reducing them, labels and numbers at their edges, templates, nested sets."""

import functools
import random

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import labels as L
from quarry.functions import numbers as N
from quarry.functions import template
from quarry.operators import cache, prom, sliding
from quarry.operators.logs import LogEngine
from quarry.operators.profiles import flamebearer, html
from quarry.operators.prom import PromEngine
from quarry.operators.traces import nested_sets
from quarry.plans import traceql
from quarry.plans.lexer import QueryError
from quarry.sources import tables


@pytest.fixture(scope="module")
def samples(spark):
    rnd = random.Random(9)
    rows, odd = [], [float("nan"), float("inf"), 0.0, -1.0]
    for s in range(6):
        t = 0
        for k in range(120):
            t += rnd.choice([5_000, 15_000, 15_000, 90_000])
            v = rnd.choice(odd) if s == 5 and k % 7 == 0 else float(rnd.randrange(50)) if s % 2 else float(k * 3 % 40)
            rows.append(({"__name__": "m", "s": str(s)}, t, v))
    return spark.createDataFrame(rows, "labels map<string,string>, ts_ms long, value double").repartition(5)


@pytest.mark.parametrize("name", sorted(sliding.FUNCTIONS))
def test_chunks(samples, name, monkeypatch):
    """Chunks of few steps give what a fan-out gives, with labels and with a series table."""
    ask = lambda e: {(r.labels["s"], r.step_ms): r.value for r in e.query_range(f"{name}(m[5m])", 0, 4_000_000, 15_000).collect()}
    monkeypatch.setattr(prom, "OVERLAP", 10**9)
    want = ask(PromEngine(samples))
    monkeypatch.setattr(prom, "OVERLAP", 1)
    monkeypatch.setattr(sliding, "STEPS", 20)
    monkeypatch.setattr(sliding, "WINDOWS", 1)
    ids, series = tables.with_series(samples)
    for got in (ask(PromEngine(samples)), ask(PromEngine(ids, series=series))):
        assert set(got) == set(want) and len(want) > 500
        for k, v in want.items():
            assert got[k] == pytest.approx(v, rel=1e-9, abs=1e-7, nan_ok=True), k


@pytest.mark.parametrize("cut", [[[0], [1, 2]], [[2, 1], [0]], [[2], [0, 1]], [[0, 1, 2]], [[2, 1, 0]]])
def test_sums_in_time(spark, cut):
    """Doubles are summed in the order of time, however samples are partitioned: floor shows the last place."""
    v, schema = [73.32, 17.99, 8.69], "labels map<string,string>, ts_ms long, value double"
    parts = [spark.createDataFrame([({"__name__": "m"}, 1000 * (k + 1), v[k]) for k in part], schema).coalesce(1) for part in cut]
    e = PromEngine(functools.reduce(DataFrame.unionByName, parts))
    one = lambda q: [r.value for r in e.query_range(q, 10_000, 10_000, 10_000).collect()]
    assert one("sum_over_time(m[10s])") == [73.32 + 17.99 + 8.69] != [100.0]
    assert one("floor(sum_over_time(m[10s]))") == [99.0]
    assert one("avg_over_time(m[10s])") == [(73.32 + 17.99 + 8.69) / 3]


def test_whole_match(spark):
    e = PromEngine(spark.createDataFrame([({"__name__": "m", "x": "a\n"}, 0, 1.0), ({"__name__": "m", "x": "a"}, 0, 2.0)], "labels map<string,string>, ts_ms long, value double"))
    assert [r.value for r in e.query('m{x=~"a"}', 0).collect()] == [2.0]
    assert [r.value for r in e.query('m{x!~"a"}', 0).collect()] == [1.0]


def test_whole_division(spark):
    """Nanoseconds of a whole millisecond, and one before and after it."""
    rows = [(1_704_067_200_000 + k) * 10**6 + d for k in range(2000) for d in (-1, 0, 1)] + [-1, -(10**6), -(10**6) - 1]
    got = spark.createDataFrame([(x,) for x in rows], "x long").select("x", N.floor_div(F.col("x"), 10**6).alias("f"), N.ceil_div(F.col("x"), 10**6).alias("c")).collect()
    assert all((r.f, r.c) == (r.x // 10**6, -(-r.x // 10**6)) for r in got)


def test_log_step_bounds(spark):
    """A line at a step's end is in it, one a nanosecond later is not."""
    t = 1_704_067_260_000_000_000
    e = LogEngine(spark.createDataFrame([(t, "a", {"j": "1"}), (t + 1, "b", {"j": "1"})], "ts_ns long, line string, labels map<string,string>"))
    got = {r.step_ms: r.value for r in e.query_range('sum(count_over_time({j="1"}[1m]))', t, t, 60_000).collect()}
    assert got == {t // 10**6: 1.0, t // 10**6 + 60_000: 1.0}


def test_key_round_trip(spark):
    sets = [{}, {"a": "1"}, {"b": 'x"\\', "a": "é\n"}]
    frame = spark.createDataFrame([(x,) for x in sets], "labels map<string,string>")
    assert [r.l for r in frame.select(L.of_key(L.key(F.col("labels"))).alias("l")).collect()] == sets


TEMPLATES = {
    "{{ __timestamp__.Unix }}": "1700000001",
    '{{ printf "%q" __line__ }}': '"the \\"line\\""',
    "{{ alignLeft 2 .foo }}": "ba",
    '{{ unixToTime "" }}': None,
    '{{ unixToTime "1700000001" }}': "2023-11-14 22:13:21 +0000 UTC",
    '{{if gt (int .n) 20}}big{{else if gt (int .n) 10}}mid{{else}}small{{end}}': "mid",
    "{{ with .missing }}x{{ else }}y{{ end }}": "y",
    "{{ range $i, $e := (fromJson .j).l }}{{ $i }}={{ .k }};{{ end }}": "0=1;1=2;",
    "{{ (fromJson .j).a.b }}": "x",
    '{{ printf "%05d|%-5s|%.2f" .n .foo .n }}': "00012|bar  |12.00",
    'a {{- " b " -}} c': "a b c",
    "{{ $x := .foo }}{{ $x | upper }}": "BAR",
    '{{ date "2006-01-02" (toDate "2006-01-02" "2024-03-01") }}': "2024-03-01",
    "{{ if and .foo (not .missing) }}1{{ end }}": "1",
    '{{ range fromJson "[]" }}z{{ else }}none{{ end }}': "none",
    '{{ .foo | replace "a" "o" | title }}{{/* a comment */}}': "Bor",
    '{{ if or .missing (eq .foo "bar" ) }}{{ len .foo }}{{ end }}': "3",
}


@pytest.mark.parametrize("text", TEMPLATES)
def test_template(spark, text):
    row = ({"foo": "bar", "n": "12", "j": '{"a":{"b":"x"},"l":[{"k":1},{"k":2}]}'}, 'the "line"', 1_700_000_001_000_000_000)
    frame = spark.createDataFrame([row], "labels map<string,string>, line string, ts_ns long")
    assert frame.select(template.compile(text, F.col("labels"), F.col("line"), F.col("ts_ns")).alias("x")).first().x == TEMPLATES[text]


@pytest.mark.parametrize("text", ["{{ if .a }}x", "{{ nothing .a }}", "{{ end }}", "{{ (.a }}", "{{ $x }}"])
def test_bad_template(spark, text):
    with pytest.raises(QueryError):
        template.compile(text, F.col("labels"), F.col("line"), F.col("ts_ns"))


def test_nested_sets(spark):
    rnd = random.Random(4)
    rows = [(f"t{t}", str(k), str(rnd.randrange(k)) if k and rnd.random() < 0.9 else rnd.choice([None, "away"]), rnd.randrange(9)) for t in range(5) for k in range(30)]
    rows += [("ring", "1", "2", 0), ("ring", "2", "1", 0)]
    got = {(r.trace_id, r.span_id): r for r in nested_sets(spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, start_ns long")).collect()}
    parent = {(t, s): (t, p) for t, s, p, _ in rows}
    assert set(got) == {(t, s) for t, s, _, _ in rows if t != "ring"}
    for x in got:
        up, ups = parent[x], set()
        while up in got:
            ups.add(up)
            up = parent[up]
        assert {y for y in got if y[0] == x[0] and got[y]._left < got[x]._left and got[x]._right < got[y]._right} == ups
        assert got[x]._parent == (got[parent[x]]._left if parent[x] in got else -1)


@pytest.mark.parametrize("query", ["{ name + 1 > 2 }", "{ duration = `x` }", "{ status > ok }", "{ name && true }", "{ duration =~ `x` }", "{ !name }", "{ -name = 1 }", "{ } | compare()", "{ } | compare({ }, 0)", "{ } | compare({ }, 5, 2, 1)", "({ } | rate()) / { }", "1 + 2"])
def test_ill_typed(query):
    with pytest.raises(QueryError):
        traceql.parse(query)


@pytest.mark.parametrize("query", ["{ .a < 5 && name != nil }", "{ duration > 1 }", "{ .a =~ `x` }", "{ parent = nil }", "{ kind = server || status != error }", "({ } | rate()) * 2 + ({ } | rate())"])
def test_well_typed(query):
    traceql.parse(query)


def test_range_cache(samples, tmp_path):
    """What is kept is not asked again, gaps are filled on both sides, and new steps are never kept."""
    engine = PromEngine(samples)
    asked = []
    inner = engine.query_range
    engine.query_range = lambda q, a, b, s: asked.append((a, b)) or inner(q, a, b, s)
    kept = cache.RangeCache(engine, str(tmp_path), lag_ms=60_000)
    values = lambda df: sorted((r.labels["s"], r.step_ms, r.value) for r in df.where("not isnan(value)").collect())
    want = lambda a, b: values(inner("avg_over_time(m[5m])", a, b, 60_000))
    ask = lambda a, b, now=10**12: values(kept.query_range("avg_over_time(m[5m])", a, b, 60_000, now))
    assert ask(600_000, 1_200_000, 1_140_000) == want(600_000, 1_200_000) and asked == [(600_000, 1_080_000), (1_140_000, 1_200_000)]
    asked.clear()
    assert ask(660_000, 900_000) == want(660_000, 900_000) and asked == []
    assert ask(300_000, 1_500_000) == want(300_000, 1_500_000) and asked == [(300_000, 540_000), (1_140_000, 1_500_000)]
    asked.clear()
    assert ask(2_400_000, 2_520_000) == want(2_400_000, 2_520_000) and asked == [(2_400_000, 2_520_000)]
    assert ask(0, 60_000, 0) == want(0, 60_000)


def test_flame_page():
    names, levels = flamebearer([("", 0, 0, 10), ("a<b", 1, 4, 7), ("b", 1, 3, 3), ("a<b\x1fc", 2, 3, 3)])
    page = html(names, levels)
    assert page.count("<div ") == 4 and 'left:70.0000%;width:30.0000%;top:18px" title="b: 3 (3 own)"' in page and "a&lt;b" in page
    assert html(["total"], []).count("<div ") == 0
