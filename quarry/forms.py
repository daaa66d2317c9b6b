"""Further forms of the operators, each with its query and SQL: modifiers, units, templates, trace intrinsics, metadata."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import discovery
from .operators.logs import LogEngine
from .operators.profiles import SEP, ProfileEngine
from .operators.prom import PromEngine
from .operators.traces import TraceEngine
from .queries import _BASE, _E, _JOIN, _L, _O, _P, _SAMPLES, _SP, _V, _C, CPU, DAY, END, ORACLE, QUERIES, START, W, _flat, _lines, _logql, _prom, _trace
from .sources import demo, formats, otlp, remote_write, safety, tables

# metrics

_SHOW = 'select u as "user", t as step_ms, round({}, 7) as value from {}'
_prom("J2_ignoring", f'label_replace({_V}, "mark", "v", "", "") - ignoring (mark) {_C}', ("user", "mark"), f"""{_JOIN} select u as "user", '' as mark, t as step_ms, round(v - o, 7) as value from a join b using (u, t)""")
_prom("J2_ignoring_group", f"{_V} - ignoring (user) group_left sum({_C})", ("user",), f"{_JOIN} {_SHOW.format('v - o', 'a join (select t, sum(o) as o from b group by t) using (t)')}")
_prom("J3_group_right", f"sum({_V}) / on () group_right {_C}", ("user",), f"{_JOIN} {_SHOW.format('v / o', 'b join (select t, sum(v) as v from a group by t) using (t)')}")
_prom("J3_include", f'{_V} * on (user) group_left (mark) label_replace({_C}, "mark", "m$1", "user", "(.).*")', ("user", "mark"), f"""{_JOIN} select u as "user", 'm' || left(u, 1) as mark, t as step_ms, round(v * o, 7) as value from a join b using (u, t)""")
_prom("J7_atan2", f"{_V} atan2 {_C}", ("user",), f"{_JOIN} {_SHOW.format('atan2(v, o)', 'a join b using (u, t)')}")
_COUNTED = f"""{_BASE}, v as (select u, t, c from b where n = 'view'), k as (select u, t, c as o from b where n = 'click')"""
_prom("J7_mod", "count_over_time(view[2d]) % count_over_time(click[2d])", ("user",), f"{_COUNTED} {_SHOW.format('(c % o)::double', 'v join k using (u, t)')}")
_prom("J7_pow", "count_over_time(view[2d]) ^ count_over_time(click[2d])", ("user",), f"{_COUNTED} {_SHOW.format('pow(c, o)', 'v join k using (u, t)')}")
for _key, _op, _sql in (("eq", "==", "="), ("ne", "!=", "<>"), ("le", "<=", "<=")):
    _prom(f"J7_{_key}", f"count_over_time(view[2d]) {_op} count_over_time(click[2d])", ("user",), f"""{_BASE} {_SHOW.format('x.c::double', f"(select u, t, c from b where n = 'view') x join (select u, t, c from b where n = 'click') y using (u, t) where x.c {_sql} y.c")}""")
_prom("J7_bool_ne", "count_over_time(view[2d]) != bool count_over_time(click[2d])", ("user",), f"""{_BASE} {_SHOW.format('(x.c <> y.c)::double', "(select u, t, c from b where n = 'view') x join (select u, t, c from b where n = 'click') y using (u, t)")}""")
for _fn in ("exp", "tan", "sinh", "cosh", "tanh", "asinh", "asin", "acos", "atanh"):
    _prom(f"I_{_fn}", f"{_fn}(sgn({_V}) * ({_V} % 1000) / 1000 - 0.25)", ("user",), f"{_L} {_SHOW.format(f'{_fn}(sign(v) * fmod(v, 1000) / 1000 - 0.25)', 'm')} where n = 'view'")
_prom("I_acosh", f"acosh({_V} % 100 + 2)", ("user",), f"{_L} {_SHOW.format('acosh(fmod(v, 100) + 2)', 'm')} where n = 'view' and v >= 0")
QUERIES["I_acosh"] = lambda spark, d: _flat(PromEngine(demo.metrics(spark, d)).query_range(f"acosh(({_V} >= 0) % 100 + 2)", START, END, DAY), ("user",))
_prom("I_pi", "vector(pi())", (), " select t as step_ms, round(pi(), 7) as value from grid")
_prom("I_clamp", f"clamp({_V}, 20, 60)", ("user",), f"{_L} {_SHOW.format('greatest(20.0, least(60.0, v))', 'm')} where n = 'view'")
_prom("I5_round_to", f"round({_V}, 5)", ("user",), f"{_L} {_SHOW.format('floor(v * (1 / 5.0::double) + 0.5) / (1 / 5.0::double)', 'm')} where n = 'view'")
_prom("I13_at_end", "sum_over_time(view[2d] @ end())", ("user",), f""", w as (select u, sum(v) as v from s where n = 'view' and ts > (select max(t) from grid) - {2 * DAY} and ts <= (select max(t) from grid) group by u) {_SHOW.format('v', 'w cross join grid')}""")
_prom("I13_negative_offset", "sum_over_time(view[1d] offset -1d)", ("user",), f""", w as (select u, t, v from s join grid on ts > t and ts <= t + {DAY} where n = 'view') {_SHOW.format('sum(v)', 'w')} group by u, t""")
_prom("F1_not_regex", 'sum_over_time({__name__=~"view|click", __name__!~"c.*", user!="1"}[2d])', ("user",), f"{_L} {_SHOW.format('v', 'm')} where n = 'view' and u <> '1'")
_prom("A9_limitk", f"limitk(2, {_V})", ("user",), f"{_L} {_SHOW.format('v', '(select *, row_number() over (partition by t order by u) as k from m where n = ' + chr(39) + 'view' + chr(39) + ')')} where k <= 2")
_prom("R27_double_exponential_smoothing", "double_exponential_smoothing(view[2d], 0.5, 0.3)", ("user",), f"""{W}, q as (select u, t, list(v order by ts) as q from w where n = 'view' group by u, t having count(*) > 1),
 y as (select u, t, list_reduce(list_concat([{{'s': q[1], 'b': q[2] - q[1]}}], list_transform(q[2:], lambda x: {{'s': x, 'b': 0.0::double}})),
  lambda a, x: {{'s': 0.5 * x.s + 0.5 * (a.s + a.b), 'b': 0.3 * (0.5 * x.s + 0.5 * (a.s + a.b) - a.s) + 0.7 * a.b}}).s as v from q) {_SHOW.format('v', 'y')}""")
_prom("O2_sort_by_label", f'sort_by_label({_V}, "user")', ("user",), f"{_L} {_SHOW.format('v', 'm')} where n = 'view'")


def _prom_at(key: str, query: str, labels: tuple[str, ...], sql: str, source: Callable[[SparkSession, str], DataFrame], at: int = START) -> None:
    QUERIES[key] = lambda spark, d: _flat(PromEngine(source(spark, d)).query(query, at), labels)
    ORACLE[key] = sql


_BOUNDS = "(1000), (10000), (30000), (60000), ('inf'::double)"
_HIST = f"""with h as (select l_returnflag as f, le, count(*) filter (l_extendedprice <= le)::double as c from lineitem cross join (values {_BOUNDS}) b(le) group by f, le),
p as (select *, lag(le, 1, 0) over w as low, lag(c, 1, 0) over w as below, max(c) over (partition by f) as total, row_number() over w as k from h window w as (partition by f order by le))"""
_prom_at("I14_histogram_quantile", "histogram_quantile(0.4, price_bucket)", ("flag",), f"""{_HIST}, r as (select f, min(k) as k from p where c >= 0.4 * total group by f)
select f as flag, {START} as step_ms, round(case when isinf(le) then low else low + (le - low) * (0.4 * total - below) / (c - below) end, 7) as value from p join r using (f, k)""", demo.price_buckets)


def _series_count(spark: SparkSession, d: str) -> DataFrame:
    rows = PromEngine(demo.metrics(spark, d)).query_range('count by (__name__) (last_over_time({__name__=~".+"}[40d]))', END, END, DAY)
    return _flat(rows, ("__name__",))


QUERIES["A19_series_count"] = _series_count
ORACLE["A19_series_count"] = f"select event_type as name, {END} as step_ms, count(distinct user_id)::double as value from events where epoch_us(ts) // 1000 <= {END} and epoch_us(ts) // 1000 > {END - 40 * DAY} group by event_type"
QUERIES["R26_matrix"] = lambda spark, d: PromEngine(demo.metrics(spark, d)).query('view{user="3"}[40d]', END).select("ts_ms", "value")
ORACLE["R26_matrix"] = f"select epoch_us(ts) // 1000 as ts_ms, value from events where event_type = 'view' and user_id = 3 and epoch_us(ts) // 1000 <= {END}"

def _by_id(key: str, query: str, labels: tuple[str, ...], like: str) -> None:
    """The same over a series table and samples with its ids."""
    def run(spark: SparkSession, d: str) -> DataFrame:
        samples, series = tables.with_series(demo.metrics(spark, d))
        return _flat(PromEngine(samples, series=series).query_range(query, START, END, DAY), labels)

    QUERIES[key], ORACLE[key] = run, ORACLE[like]


_by_id("S1_series_table", "rate(view[2d]) * 1000", ("user",), "R11_rate")
_by_id("S2_sample_scan", 'sum by (__name__) (last_over_time({__name__!=""}[2d]))', ("__name__",), "A7_by")
_H = f"""grid as (select range as t from range({START}, {START + 3 * DAY} + 1, 3600000)), s as (select cast(user_id as varchar) as u, epoch_us(ts) // 1000 as ts, value as v from events where event_type = 'view'),
 w as (select u, t, ts, v from s join grid on ts > t - {2 * DAY} and ts <= t)"""
for _fn, _sql in {"sum": "sum(v)", "avg": "avg(v)", "min": "min(v)", "max": "max(v)", "stddev": "stddev_pop(v)", "last": "arg_max(v, ts)", "count": "count(*)::double"}.items():
    QUERIES[f"J20_chunks_{_fn}"] = lambda spark, d, q=f"{_fn}_over_time(view[2d])": _flat(PromEngine(demo.metrics(spark, d)).query_range(q, START, START + 3 * DAY, 3_600_000), ("user",))
    ORACLE[f"J20_chunks_{_fn}"] = f"""with {_H} select u as "user", t as step_ms, round({_sql}, 7) as value from w group by u, t"""

QUERIES["S14_otlp_metrics"] = lambda spark, d: _flat(PromEngine(otlp.samples(demo.otlp_metrics(spark, d))).query_range("sum by (user_id, job) (sum_over_time(view[2d]))", START, END, DAY), ("user_id", "job"))
ORACLE["S14_otlp_metrics"] = f"""with {_SAMPLES.format(step=DAY)} {_L} select u as user_id, 'events' as job, t as step_ms, round(v, 7) as value from m where n = 'view'"""
QUERIES["S14_otlp_logs"] = lambda spark, d: tables.log_labels(otlp.logs(demo.otlp_logs(spark, d))).select("ts_ns", "line", *(F.col("labels")[x].alias(x) for x in ("service_name", "http_status", "level")))
ORACLE["S14_otlp_logs"] = f"{_O} select ts_ns, line, 'orders' as service_name, st as http_status, 'INFO' as level from o"
QUERIES["S14_otlp_traces"] = lambda spark, d: TraceEngine(otlp.spans(demo.otlp_spans(spark, d))).select("{ kind = server && status = ok } > { .turn > 1 && duration > 100us }").select("trace_id", "span_id", "service", "start_ns", "duration_ns")
ORACLE["S14_otlp_traces"] = f"{_SP} select tid as trace_id, sid as span_id, role as service, c * 1000000000 + k * 1000000 as start_ns, dur as duration_ns from p a where k > 1 and dur > 100000 and exists (select 1 from p b where b.c = a.c and b.k = a.k - 1)"
for _v in (1, 2):
    QUERIES[f"S15_remote_write_v{_v}"] = lambda spark, d, v=_v: remote_write.read(remote_write.write(demo.metrics(spark, d), v)).select(F.col("labels")["__name__"].alias("name"), F.col("labels")["user"].alias("user"), "ts_ms", "value")
    ORACLE[f"S15_remote_write_v{_v}"] = """select event_type as name, user_id::varchar as "user", epoch_us(ts) // 1000 as ts_ms, value from events"""
QUERIES["S16_consumer"] = lambda spark, d: formats.consume(demo.raw_records(spark, d)).select("ts_ns", "body", "severity_text", F.col("attributes")["cust"].alias("cust"), F.col("attributes")["k"].alias("k"))
ORACLE["S16_consumer"] = f"{_O} select ts_ns, st as body, 'WARN' as severity_text, cu::varchar as cust, null as k from o union all select epoch_us(ts) * 1000, '', '', null, props->>'k' from events"
QUERIES["S17_formats"] = lambda spark, d: formats.parse(demo.raw_records(spark, d).select(F.col("body").alias("line"))).groupBy("format").agg(F.count("*").alias("n"))
ORACLE["S17_formats"] = "select 'logfmt' as format, count(*) as n from orders union all select 'generic-json', count(*) from events"
for _key, _call in (("count", "histogram_count(price)"), ("sum", "histogram_sum(price)"), ("avg", "histogram_avg(price)"), ("quantile", "histogram_quantile(0.4, price)")):
    QUERIES[f"S5_native_{_key}"] = lambda spark, d, q=_call: _flat(PromEngine(demo.price_buckets(spark, d), histograms=demo.price_histograms(spark, d)).query(q, START), ("flag",)).withColumn("value", F.round("value", 4))
_NATIVE = f"""with k as (select l_returnflag as f, ceil(log2(l_extendedprice) * 2)::int - 1 as i, count(*)::double as n from lineitem group by all), s as (select *, sum(n) over (partition by f order by i) as c, sum(n) over (partition by f) as total from k),
h as (select f, arg_min(i, i) as i, arg_min(c - n, i) as below, arg_min(n, i) as n, any_value(total) as total from s where c >= 0.4 * total group by f)
select f as flag, {START} as step_ms, round(pow(2, i / 2.0) * pow(sqrt(2.0), (0.4 * total - below) / n), 4) as value from h"""
ORACLE["S5_native_quantile"] = _NATIVE
for _key, _sql in (("count", "count(*)::double"), ("sum", "sum(l_extendedprice)"), ("avg", "avg(l_extendedprice)")):
    ORACLE[f"S5_native_{_key}"] = f"select l_returnflag as flag, {START} as step_ms, round({_sql}, 4) as value from lineitem group by l_returnflag"

# logs

_logql("L10_without", 'sum_over_time({event_type="view"} | json | unwrap k [1d]) without (user)', ("event_type", "user"), f"""{_E} select n as event_type, '' as "user", t as step_ms, sum(k) as value from w where n = 'view' group by n, t""")
_logql("L3_bytes_rate", 'sum by (event_type) (bytes_rate({event_type="view"}[1d])) * 1000', ("event_type",), f"{_E} select n as event_type, t as step_ms, round(sum(strlen(props)) / {DAY / 1000} * 1000, 7) as value from w where n = 'view' group by n, t")
_logql("L11_offset", 'sum by (event_type) (count_over_time({event_type="view"}[1d] offset 1d))', ("event_type",), f"{_E}, o as (select n, t from e join grid on us > (t - 2 * {DAY}) * 1000 and us <= (t - {DAY}) * 1000) select n as event_type, t as step_ms, count(*)::double as value from o where n = 'view' group by n, t")
QUERIES["L11_shifted_offset"] = lambda spark, d: _flat(LogEngine(demo.logs(spark, d), shifted_offsets=True).query_range('sum by (event_type) (count_over_time({event_type="view"}[1d] offset 1d))', START * 10**6, (END - DAY) * 10**6, DAY), ("event_type",))
ORACLE["L11_shifted_offset"] = f"{_E}, o as (select n, t from e join grid on us > (t - 2 * {DAY}) * 1000 and us <= (t - {DAY}) * 1000) select n as event_type, t - {DAY} as step_ms, count(*)::double as value from o where n = 'view' group by n, t"
QUERIES["M17_stream_costs"] = lambda spark, d: discovery.stream_costs(demo.access_logs(spark, d)).select(F.col("labels")["status"].alias("status"), "entries", "bytes")
ORACLE["M17_stream_costs"] = f"{_O} select st as status, count(*) as entries, sum(strlen(line))::bigint as bytes from o group by st"
_PER = f"{_E}, x as (select n, u, t, count(*)::double as c from w group by n, u, t)"
for _fn, _sql in {"avg": "avg(c)", "min": "min(c)", "max": "max(c)", "count": "count(*)::double", "stddev": "stddev_pop(c)", "stdvar": "var_pop(c)"}.items():
    _logql(f"A13_{_fn}", f'{_fn} by (event_type) (count_over_time({{event_type=~".+"}}[1d]))', ("event_type",), f"{_PER} select n as event_type, t as step_ms, round({_sql}, 7) as value from x group by n, t")
_logql("A13_without", 'sum without (user) (count_over_time({event_type=~".+"}[1d]))', ("event_type",), f"{_PER} select n as event_type, t as step_ms, sum(c) as value from x group by n, t")
_N = f"{_E}, x as (select n, t, count(*)::double as c from w group by n, t)"
_ALL = 'sum by (event_type) (count_over_time({event_type=~".+"}[1d]))'
for _fn, _order in (("topk", "c desc"), ("bottomk", "c")):
    _logql(f"A14_{_fn}", f"{_fn}(2, {_ALL})", ("event_type",), f"{_N} select n as event_type, t as step_ms, c as value from (select *, row_number() over (partition by t order by {_order}, n) as k from x) where k <= 2")
_logql("A14_sort", f"sort_desc({_ALL})", ("event_type",), f"{_N} select n as event_type, t as step_ms, c as value from x")
_FEW = 'sum by (event_type) (count_over_time({event_type=~"view|click"}[1d]))'
for _op, _sql in {"and": "where n in ('view', 'click')", "unless": "where n not in ('view', 'click')"}.items():
    _logql(f"J9_{_op}", f"{_ALL} {_op} {_FEW}", ("event_type",), f"{_N} select n as event_type, t as step_ms, c as value from x {_sql}")
_logql("J9_or", f"({_FEW}) or ({_ALL} * 2)", ("event_type",), f"{_N} select n as event_type, t as step_ms, case when n in ('view', 'click') then c else c * 2 end as value from x")
_logql("J10_literal", f"100 - {_ALL} / 2", ("event_type",), f"{_N} select n as event_type, t as step_ms, 100 - c / 2 as value from x")
_logql("J11_zero", f"({_ALL} / 0) or vector(1)", ("event_type",), f"{_N} select n as event_type, t as step_ms, 'nan'::double as value from x union all select '', t, 1.0 from grid")
_logql("J11_bool", f"{_ALL} > bool 70", ("event_type",), f"{_N} select n as event_type, t as step_ms, (c > 70)::double as value from x")
_logql("I8_logql_label_replace", f'label_replace({_ALL}, "first", "$1", "event_type", "(.).*")', ("event_type", "first"), f"""{_N} select n as event_type, left(n, 1) as "first", t as step_ms, c as value from x""")
_logql("L4_rate_counter", 'rate_counter({event_type="view"} | json | unwrap k [1d]) by (event_type) * 1000', ("event_type",), f"""{_E}, l as (select *, lag(k) over (order by us) as pk, (lag(us) over (order by us) + 999) // 1000 as pts, (us + 999) // 1000 as ms from e where n = 'view'),
 g as (select t, count(*) as c, arg_max(k, us) - arg_min(k, us) + coalesce(sum(case when pk > k and pts > t - {DAY} then pk end), 0) as moved, arg_min(k, us) as f, (max(ms) - min(ms)) / 1000.0 as took from l join grid on ms > t - {DAY} and ms <= t group by t),
 h as (select *, case when moved > 0 and f >= 0 then least({DAY / 1000}, took * f / moved) else {DAY / 1000} end as b, took / (c - 1) * 1.1 as most from g where c > 1)
 select 'view' as event_type, t as step_ms, round(case when took > 0 then moved * ((took + case when b < most then b else most / 2.2 end) / took) / {DAY / 1000} else 0 end * 1000, 7) as value from h union all select 'view', t, 0.0 from g where c = 1""")

_EVER = 10_000 * DAY


def _logs_at(key: str, query: str, labels: tuple[str, ...], sql: str, source=demo.access_logs) -> None:
    """All lines up to a day far ahead."""
    QUERIES[key] = lambda spark, d: _flat(LogEngine(source(spark, d)).query(query, _EVER * 10**6), labels)
    ORACLE[key] = sql


_logs_at("F29_unwrap_duration", 'sum by (status) (sum_over_time({job="orders"} | logfmt | unwrap duration(took) [10001d]))', ("status",), f"{_O} select st as status, {_EVER} as step_ms, round(sum(took) / 1000.0, 7) as value from o group by st")
_logs_at("F29_unwrap_bytes", 'sum by (status) (sum_over_time({job="orders"} | logfmt | label_format size="{{.cust}}KiB" | unwrap bytes(size) [10001d]))', ("status",), f"{_O} select st as status, {_EVER} as step_ms, sum(cu * 1024.0)::double as value from o group by st")
_logs_at("L_error_lines", 'sum by (__error__) (count_over_time({job="orders"} | logfmt | unwrap prio [10001d]))'.replace("count_over_time", "sum_over_time"), ("__error__",), f"{_O} select 'SampleExtractionErr' as __error__, {_EVER} as step_ms, 0.0::double as value from o limit 1")
_lines("F2b_level", '{level="error"}', ("level", "service_name"), f"{_O} select ts_ns, line, 'ERROR' as level, 'orders' as service_name from o where st = 'F'", demo.order_records)
_lines("F2b_level_regex", '{level=~"inf.|warn"}', ("level",), f"{_O} select ts_ns, line, case st when 'O' then 'INFO' else 'WARN' end as level from o where st <> 'F'", demo.order_records)
_lines("F2b_msg", '{service_name="orders", msg="URGENT"}', ("level",), f"{_O} select ts_ns, line, case st when 'O' then 'INFO' when 'F' then 'ERROR' else 'WARN' end as level from o where line like '%URGENT%'", demo.order_records)
_lines("F2b_trace_id", '{trace_id=~".*a$"}', ("trace_id",), f"{_O} select ts_ns, line, lower(printf('%032x', cu)) as trace_id from o where cu % 16 = 10", demo.order_records)
_lines("F4_chain", '{job="orders"} != "URGENT" or "LOW"', ("status",), f"{_O} select ts_ns, line, st as status from o where not (line like '%URGENT%' or line like '%LOW%')")
_lines("F7_ip6", '{job="orders"} | logfmt | label_format six="2001:db8::{{.cust}}" | six = ip("2001:db8::/120")', ("six",), f"{_O} select ts_ns, line, '2001:db8::' || cu as six from o where cu <= 99")
_lines("F12_bytes", '{job="orders"} | logfmt | label_format size="{{.cust}}KiB" | size > 0.03MiB', ("size",), f"{_O} select ts_ns, line, cu || 'KiB' as size from o where cu * 1024 > 0.03 * 1048576")
_lines("F10_error_kept", '{job="orders"} | logfmt | prio > 5', ("__error__",), f"{_O} select ts_ns, line, 'LabelFilterError' as __error__ from o")
_lines("F15_distinct_two", '{job="orders"} | logfmt | distinct prio, status', ("prio", "status"), f"""{_O}, a as (select * from o qualify row_number() over (partition by pr order by ts_ns, line) = 1) select ts_ns, line, pr as prio, st as status from a qualify row_number() over (partition by st order by ts_ns, line) = 1""")
_lines("F15_distinct_missing", '{job="orders"} | logfmt | drop prio="5-LOW" | distinct prio, status', ("prio",), f"""{_O}, a as (select * from o where pr <> '5-LOW' qualify row_number() over (partition by pr order by ts_ns, line) = 1), b as (select * from a qualify row_number() over (partition by st order by ts_ns, line) = 1)
 select ts_ns, line, pr as prio from b union all select ts_ns, line, '' from o where pr = '5-LOW'""")
_lines("F20_if", '{job="orders"} | logfmt | line_format "{{ if eq .status `F` }}done {{ .cust }}{{ else if gt (int .cust) 500 }}late{{ else }}-{{ end }}"', ("status",), f"{_O} select ts_ns, case when st = 'F' then 'done ' || cu when cu > 500 then 'late' else '-' end as line, st as status from o")
_lines("F20_printf", '{job="orders"} | logfmt | line_format "{{ printf `%05d|%-3s|%q` .cust .status .prio }}"', ("status",), f"""{_O} select ts_ns, lpad(cu::varchar, 5, '0') || '|' || rpad(st, 3, ' ') || '|"' || pr || '"' as line, st as status from o""")
_lines("F20_range", '{event_type="view"} | line_format "{{ with fromJson __line__ }}{{ .k }}{{ end }}{{ range $i, $x := fromJson `[1,2]` }},{{ $i }}{{ . }}{{ end }}"', ("event_type",), "select epoch_us(ts) * 1000 as ts_ns, (props->>'k') || ',01,12' as line, event_type from events where event_type = 'view'", demo.logs)
_lines("F20_error", '{job="orders"} | logfmt | line_format "{{ unixToTime .cust }}"', ("__error__",), f"""{_O} select ts_ns, case when length(cu::varchar) = 5 then strftime(make_timestamp(cu * 86400000000), '%Y-%m-%d %H:%M:%S +0000 UTC') else line end as line, case when length(cu::varchar) = 5 then '' else 'TemplateFormatErr' end as __error__ from o""")
_lines("F20_dates", '{job="orders"} | line_format "{{ __timestamp__.Unix }} {{ date `2006-01-02 15:04` __timestamp__ }} {{ __timestamp__ | unixEpochMillis }}"', ("status",), f"{_O} select ts_ns, (ts_ns // 1000000000) || ' ' || strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%d %H:%M') || ' ' || (ts_ns // 1000000) as line, st as status from o")
_lines("F20_regex", '{job="orders"} | logfmt | line_format "{{ regexReplaceAll `[0-9]` .prio `n` }} {{ count `U` .prio }} {{ .prio | replace `-` `+` | lower | trunc 5 }}"', ("status",), f"{_O} select ts_ns, regexp_replace(pr, '[0-9]', 'n', 'g') || ' ' || (length(pr) - length(replace(pr, 'U', ''))) || ' ' || left(lower(replace(pr, '-', '+')), 5) as line, st as status from o")
_lines("F20_encodings", '{job="orders"} | logfmt | line_format "{{ .prio | b64enc }} {{ .prio | b64enc | b64dec }} {{ urlencode `a b&c` }} {{ urldecode `a%20b` }}"', ("status",), f"{_O} select ts_ns, base64(pr::blob) || ' ' || pr || ' a+b%26c a b' as line, st as status from o")
_lines("F20_units", '{job="orders"} | logfmt | line_format "{{ duration .took }} {{ bytes `2KB` }} {{ addf .cust 0.5 }} {{ mod .cust 7 }} {{ div .cust 10 }} {{ max .cust 500 }}"', ("status",), f"{_O} select ts_ns, case when took % 1000 = 0 then '0' else trim(trailing '0' from printf('%.3f', took / 1000.0)) end || ' 2000 ' || cu || '.5 ' || (cu % 7) || ' ' || (cu // 10) || ' ' || greatest(cu, 500) as line, st as status from o")
_lines("F20_pad", '{job="orders"} | logfmt | line_format "{{ alignRight 4 .cust }}|{{ alignLeft 6 .status }}|{{ .prio | trimPrefix `1-` }}|{{ hasSuffix `LOW` .prio }}|{{ substr 2 4 .prio }}|{{ .none | default `d` }}"', ("status",), f"{_O} select ts_ns, right(lpad(cu::varchar, greatest(4, length(cu::varchar))::int, ' '), 4) || '|' || rpad(st, 6, ' ') || '|' || case when starts_with(pr, '1-') then substr(pr, 3) else pr end || '|' || ends_with(pr, 'LOW') || '|' || substr(pr, 3, 2) || '|d' as line, st as status from o")
_lines("F21_decolorize", '{job="orders"} | logfmt | line_format "\\u001b[31m{{.cust}}\\u001b[0m!" | decolorize', ("status",), f"{_O} select ts_ns, cu || '!' as line, st as status from o")
_lines("F23_nested", '{event_type="view"} | line_format "{\\"a\\":{\\"b\\":[{\\"c\\":{{ (fromJson __line__).k }}}]}}" | json x="a.b[0].c"', ("x",), """select epoch_us(ts) * 1000 as ts_ns, '{"a":{"b":[{"c":' || (props->>'k') || '}]}}' as line, props->>'k' as x from events where event_type = 'view'""", demo.logs)
_lines("F24_bare", '{job="orders"} | line_format "urgent {{ __line__ }} cust=7 done" | logfmt', ("urgent", "cust", "status"), f"{_O} select ts_ns, 'urgent ' || line || ' cust=7 done' as line, '' as urgent, '7' as cust, st as status from o")
_lines("F27_entry", '{event_type="view"} | line_format "{\\"_entry\\":\\"was {{ (fromJson __line__).k }}\\",\\"a\\":\\"b\\"}" | unpack', ("a",), "select epoch_us(ts) * 1000 as ts_ns, 'was ' || (props->>'k') as line, 'b' as a from events where event_type = 'view'", demo.logs)


def _otel(spark: SparkSession, d: str) -> DataFrame:
    engine = LogEngine(demo.logs(spark, d))
    rows = engine.otel_lines(engine.query_range('{event_type="view"}', 0, 1 << 62))
    return rows.select("ts_ns", F.get_json_object("line", "$.body").alias("body"), F.get_json_object("line", "$.user").alias("user"))


QUERIES["F28_otel_adapter"] = _otel
ORACLE["F28_otel_adapter"] = """select epoch_us(ts) * 1000 as ts_ns, props as body, user_id::varchar as "user" from events where event_type = 'view'"""
QUERIES["O3_backward"] = lambda spark, d: LogEngine(demo.access_logs(spark, d)).query_range('{job="orders"} |= "URGENT"', 0, 1 << 62, limit=20).select("ts_ns", "line")
ORACLE["O3_backward"] = f"{_O} select ts_ns, line from o where line like '%URGENT%' order by ts_ns desc, line limit 20"
QUERIES["O3_forward"] = lambda spark, d: LogEngine(demo.access_logs(spark, d)).query_range('{job="orders"} | logfmt | cust > 100', 0, 1 << 62, limit=20, forward=True).select("ts_ns", "line")
ORACLE["O3_forward"] = f"{_O} select ts_ns, line from o where cu > 100 order by ts_ns, line limit 20"


def _streams(spark: SparkSession, d: str) -> DataFrame:
    engine = LogEngine(demo.access_logs(spark, d))
    found = engine.streams(engine.query_range('{job="orders"}', 0, 1 << 62))
    at = F.col("values")
    return found.select(F.col("labels")["status"].alias("status"), F.size(at).cast("long").alias("n"), F.element_at(at, 1)["ts_ns"].alias("first_ns"), F.element_at(at, -1)["line"].alias("last_line"))


QUERIES["O4_streams"] = _streams
ORACLE["O4_streams"] = f"{_O} select st as status, count(*) as n, min(ts_ns) as first_ns, arg_max(line, ts_ns) as last_line from o group by st"
QUERIES["L13_bucketed"] = lambda spark, d: _flat(LogEngine(demo.logs(spark, d)).bucketed('sum by (event_type) (rate({event_type=~".+"}[1d]))', START * 10**6, (END - DAY) * 10**6, DAY).withColumn("value", F.col("value") * 1000), ("event_type",))
ORACLE["L13_bucketed"] = f"{_N} select n as event_type, t as step_ms, round(c / {DAY / 1000} * 1000, 7) as value from x"
QUERIES["M10_volume"] = lambda spark, d: _flat(discovery.volume(demo.logs(spark, d), '{event_type=~".+"}', START * 10**6, END * 10**6, ["event_type"]), ("event_type",))
ORACLE["M10_volume"] = f"{_E} select n as event_type, {END} as step_ms, count(*)::double as value from e where us > {START} * 1000 and us <= {END} * 1000 group by n"
QUERIES["M10_volume_range"] = lambda spark, d: _flat(discovery.volume_range(demo.logs(spark, d), '{event_type=~".+"}', START * 10**6, (END - DAY) * 10**6, DAY, ["event_type"]), ("event_type",))
ORACLE["M10_volume_range"] = f"{_N} select n as event_type, t as step_ms, c as value from x"

# traces

_trace("T3_zero_dividend", "{ .turn / 2 >= 1 || .turn % 2 = 0 }", "p where k <> 0 and (k / 2.0 >= 1 or k % 2 = 0)")
_trace("T6_unary", "{ !(-.turn < -1) }", "p where not (-k < -1)")
_trace("T10_ids", '{ span:parentID = "0000000000000001" && trace:id =~ "a$" && span:id != "x" }', "p where k = 1 and tid like '%a'")
_trace("T11_events", '{ event:name = "reply" && event:timeSinceStart > 4us && link:spanID = "0000000000000001" }', "p where role = 'assistant' and k > 4")
_trace("T12_instrumentation", '{ instrumentation:name = "demo" && instrumentation:version != "2" && span.turn = 2 }', "p where k = 2")
_trace("T13_scopes", '{ span.chars > 100 && resource.service.name = "assistant" && instrumentation.lib = "chat" && event.at >= 0 }', "p where chars > 100 and role = 'assistant'")
_trace("T13_event_attribute", '{ event.at = "3" || link.kind = "root" && .turn = 2 }', "p where (role = 'assistant' and k = 3) or k = 2")
_trace("T14_parent", "{ parent.chars > 300 }", "p a where exists (select 1 from p b where b.c = a.c and b.k = a.k - 1 and b.chars > 300)")
_trace("T14_nested_set", "{ nestedSetLeft > 1 && nestedSetParent <= 2 && nestedSetRight > 0 }", "p where k in (1, 2)")
_trace("T9_trace_duration", "{ traceDuration > 7ms }", f"p where c in (select c from p group by c having max(k * 1000000 + dur) - min(k * 1000000) > 7000000)")
_trace("F34_coalesce", "{ } | by(name) | coalesce() | count() > 5", "p where n > 5")
_trace("F32_select", "{ .turn = 1 } | select(.chars, name)", "p where k = 1")
_trace("A15_sum_min_max", "{ } | max(.chars) - min(.chars) > 300 | sum(.chars) > 900", "p where c in (select c from p group by c having max(chars) - min(chars) > 300 and sum(chars) > 900)")
for _key, _op, _sql in (
    ("not_parent", "{ .turn > 0 } !< { status = error }", "p a where st = 'error' and not exists (select 1 from p b where b.c = a.c and b.k = a.k + 1 and b.k > 0)"),
    ("ancestor", "{ .turn = 3 } << { .turn > 0 }", "p a where k in (1, 2) and exists (select 1 from p b where b.c = a.c and b.k = 3) and exists (select 1 from p b where b.c = a.c and b.k = 2)"),
    ("not_descendant", "{ .turn = 1 } !>> { .turn > 0 }", "p where k = 1"),
    ("not_ancestor", "{ .turn = 3 } !<< { .turn > 0 }", "p a where k > 0 and not (k in (1, 2) and exists (select 1 from p b where b.c = a.c and b.k = 3))"),
    ("not_sibling", "{ status = error } !~ { .turn = 1 }", "p where k = 1 and st <> 'error'"),
    ("union_child", "{ .turn = 1 } &> { .turn = 2 }", "p a where k in (1, 2) and exists (select 1 from p b where b.c = a.c and b.k = 2)"),
    ("union_parent", "{ .turn = 2 } &< { .turn = 1 }", "p a where k in (1, 2) and exists (select 1 from p b where b.c = a.c and b.k = 2)"),
    ("union_descendant", "{ .turn = 0 } &>> { .turn >= 0 }", "p a where k > 0 or n > 1"),
    ("union_ancestor", "{ .turn = 2 } &<< { .turn >= 0 }", "p a where k <= 2 and exists (select 1 from p b where b.c = a.c and b.k = 2)"),
    ("union_sibling", "{ .turn = 1 } &~ { .turn >= 0 }", "p where k = 1"),
):
    _trace(f"J17_{_key}", _op, _sql)
_trace("J18_pipelines", "({ status = error } | count() > 1) && ({ } | avg(.chars) > 200)", "p where c in (select c from p where st = 'error' group by c having count(*) > 1) and c in (select c from p group by c having avg(chars) > 200)")
QUERIES["F36_gate"] = lambda spark, d: TraceEngine(demo.spans(spark, d)).select("{ status = error }", start_ns=3 * 10**9, min_ns=3_000_000, max_ns=7_300_000).select("trace_id", "span_id")
ORACLE["F36_gate"] = f"{_SP}, g as (select c, max(k * 1000000 + dur) - min(k * 1000000) as d from p group by c) select tid as trace_id, sid as span_id from p join g using (c) where st = 'error' and c >= 3 and d between 3000000 and 7300000"
QUERIES["S9_by_id"] = lambda spark, d: TraceEngine(demo.spans(spark, d)).by_id("7").select("trace_id", "span_id", "name")
ORACLE["S9_by_id"] = f"{_SP} select tid as trace_id, sid as span_id, name from p where c = 7"
QUERIES["S10_tags"] = lambda spark, d: TraceEngine(demo.spans(spark, d)).search_tags({"name": "turn-user", "turn": "2"}, min_ns=100_000).select("trace_id", "span_id")
ORACLE["S10_tags"] = f"{_SP} select tid as trace_id, sid as span_id from p where c in (select c from p where role = 'user' and k = 2 and dur >= 100000)"
QUERIES["F35_projection"] = lambda spark, d: TraceEngine(demo.spans(spark, d)).search_spans('{ .turn = 2 && resource.service.name = "user" }').select("trace_id", "span_id", F.map_keys("attributes").alias("keys"), F.col("attributes")["turn"].alias("turn")).withColumn("keys", F.array_join(F.array_sort("keys"), ","))
ORACLE["F35_projection"] = f"{_SP} select tid as trace_id, sid as span_id, 'service.name,turn' as keys, '2' as turn from p where k = 2 and role = 'user'"
QUERIES["M13_tag_names"] = lambda spark, d: TraceEngine(demo.spans(spark, d)).tag_names()
ORACLE["M13_tag_names"] = "select * from (values ('span', 'chars'), ('span', 'turn'), ('resource', 'service.name'), ('instrumentation', 'lib'), ('event', 'at'), ('link', 'kind')) x(scope, tag)"
QUERIES["M13_tag_values"] = lambda spark, d: TraceEngine(demo.spans(spark, d)).tag_values(".turn", "{ status = error }")
ORACLE["M13_tag_values"] = f"{_SP} select distinct k::varchar as value from p where st = 'error'"


def steps(spark: SparkSession, d: str, table: str, column: str) -> int:
    """The width in ms of 20 steps that cover a table whose ``column`` counts seconds."""
    return ((spark.read.parquet(f"{d}/{table}.parquet").agg(F.max(column)).first()[0] or 0) + 1) * 50


_STEP = f"{_SP}, y as (select (max(conv_id) + 1) * 50 as step from conversations), g as (select unnest(range(0, 20 * step + 1, step)) as t, step from y), x as (select * from p join g on c * 1000 + k > t - step and c * 1000 + k <= t)"


def _trace_metrics(key: str, query: str, labels: tuple[str, ...], sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        step = steps(spark, d, "conversations", "conv_id")
        return _flat(TraceEngine(demo.spans(spark, d)).metrics(query, 0, 20 * step, step), labels)

    QUERIES[key] = run
    ORACLE[key] = f"{_STEP} {sql}"


_trace_metrics("A16_metrics", "{ } | count_over_time() by (name)", ("name",), "select name, t as step_ms, count(*)::double as value from x group by name, t")
for _fn, _sql in {"rate() by (name)": "count(*) / (step / 1000.0)", "min_over_time(.chars) by (name)": "min(chars)::double", "max_over_time(.chars) by (name)": "max(chars)::double", "sum_over_time(.chars) by (name)": "sum(chars)::double", "avg_over_time(.chars) by (name)": "avg(chars)", "quantile_over_time(.chars, 0.5) by (name)": "quantile_cont(chars, 0.5)"}.items():
    _trace_metrics(f"A16_{_fn.split('(')[0]}", f"{{ }} | {_fn}", ("name",), f"select name, t as step_ms, round({_sql}, 7) as value from x group by name, t, step")
for _key, _stage, _where in (("topk", "| topk(1)", "n = 1"), ("bottomk", "| bottomk(1)", "m = 1"), ("filter", "> 3", "v > 3"), ("filter_topk", "> 3 | topk(1)", "v > 3 and n = 1")):
    _trace_metrics(f"A18_{_key}", "{ } | count_over_time() by (name) " + _stage, ("name",), f"select name, t as step_ms, v as value from (select *, row_number() over (partition by t order by v desc, name) as n, row_number() over (partition by t order by v, name) as m from (select name, t, count(*)::double as v from x group by name, t)) where {_where}")
_trace_metrics("A18_scalar", "{ } | count_over_time() by (name) * 2 + 1", ("name",), "select name, t as step_ms, (count(*) * 2.0 + 1)::double as value from x group by name, t")
_trace_metrics("A18_cross", "({ status = error } | count_over_time() by (name)) / ({ } | count_over_time() by (name))", ("name",), "select name, t as step_ms, round(count(*) filter (st = 'error') / count(*), 7) as value from x group by name, t having count(*) filter (st = 'error') > 0")
QUERIES["A17_compare"] = lambda spark, d: TraceEngine(demo.spans(spark, d)).compare("{ } | compare({ status = error }, 3)")
ORACLE["A17_compare"] = f"""{_SP}, v as (select st, unnest([{{'a': 'span.chars', 'v': chars::varchar}}, {{'a': 'span.turn', 'v': k::varchar}}, {{'a': 'resource.service.name', 'v': role}}, {{'a': 'instrumentation.lib', 'v': 'chat'}}, {{'a': 'name', 'v': name}}, {{'a': 'kind', 'v': case role when 'user' then 'client' else 'server' end}}]) as x from p),
 n as (select case st when 'error' then 'selection' else 'baseline' end as grp, x.a as attribute, x.v as value, count(*) as n from v group by all)
 select grp, attribute, value, n from n qualify row_number() over (partition by grp, attribute order by n desc, value) <= 3"""

# profiles and metadata

QUERIES["P6_series"] = lambda spark, d: (lambda step: ProfileEngine(demo.profiles(spark, d)).series(CPU, 0, 20 * step, step))(steps(spark, d, "part", "p_partkey"))
ORACLE["P6_series"] = f"{_P}, y as (select (max(p_partkey) + 1) * 50 as step from part) select (p_partkey * 1000 // step) * step as step_ms, sum(v)::double as value from q cross join y group by 1"
QUERIES["P4_folded"] = lambda spark, d: ProfileEngine(demo.profiles(spark, d)).folded(CPU, 12).select(F.translate("path", SEP, ";").alias("path"), "depth", "total")
ORACLE["P4_folded"] = f"""{_P}, x as (select array_to_string(s[1:d], ';') as path, array_to_string(s[1:d-1], ';') as parent, d as depth, v from (select s, v, unnest(range(0, len(s) + 1)) as d from q)),
 t as (select path, any_value(parent) as parent, depth, sum(v)::bigint as total from x group by path, depth), l as (select min(total) as least from (select total from t order by total desc limit 12)),
 k as (select t.* from t, l where total >= least or depth = 0)
 select path, depth::int as depth, total from k union all
 select case parent when '' then 'other' else parent || ';other' end, depth::int, sum(total)::bigint from t, l where total < least and depth > 0 and parent in (select path from k) group by parent, depth"""
QUERIES["P5_pprof"] = lambda spark, d: ProfileEngine(demo.profiles(spark, d)).pprof(CPU)
ORACLE["P5_pprof"] = f"{_P}, a as (select array_to_string(s, ';') as stack, sum(v)::bigint as value from q group by 1) select array_to_string(list_reverse(string_split(stack, ';')), ';') as locations, value from a"
QUERIES["P7_label_names"] = lambda spark, d: ProfileEngine(demo.profiles(spark, d)).label_names()
ORACLE["P7_label_names"] = "select 'service_name' as name"
QUERIES["M2_label_names"] = lambda spark, d: discovery.label_names(demo.metrics(spark, d))
ORACLE["M2_label_names"] = "select unnest(['__name__', 'user']) as name"
QUERIES["M4_metadata"] = lambda spark, d: discovery.metadata(demo.metric_points(spark, d))
ORACLE["M4_metadata"] = "select distinct event_type as name, 'gauge' as type, '1' as unit, 'values of ' || event_type as help from events"
QUERIES["M5_exemplars"] = lambda spark, d: discovery.exemplars(demo.exemplars(spark, d), demo.metrics(spark, d), [[("__name__", "=", "view")]], START, END).select(F.col("labels")["user"].alias("user"), "ts_ms", "trace_id", "value")
ORACLE["M5_exemplars"] = f"""select user_id::varchar as "user", epoch_us(ts) // 1000 as ts_ms, lower(printf('%032x', event_id)) as trace_id, value from events where event_type = 'view' and event_id % 10 = 0 and epoch_us(ts) // 1000 between {START} and {END}"""
QUERIES["M8_log_series"] = lambda spark, d: discovery.series(demo.access_logs(spark, d), [[("job", "=", "orders")]]).select(F.col("labels")["job"].alias("job"), F.col("labels")["status"].alias("status"))
ORACLE["M8_log_series"] = "select distinct 'orders' as job, o_orderstatus as status from orders"
QUERIES["M9_detected_fields"] = lambda spark, d: discovery.detected_fields(demo.logs(spark, d)).select("name", "type", (F.col("cardinality") > 50).alias("many"))
ORACLE["M9_detected_fields"] = "select 'k' as name, 'string' as type, true as many"
QUERIES["M9_field_values"] = lambda spark, d: discovery.field_values(demo.logs(spark, d), "k")
ORACLE["M9_field_values"] = "select distinct props->>'k' as value from events"

# the guard on rates

_DAYS = "with e as (select epoch_us(ts) * 1000 as ts_ns, props as line, row_number() over (partition by epoch_us(ts) // 86400000000 order by ts, props) as k, epoch_us(ts) // 86400000000 as d from events)"
_LIMITED = {
    "drop": (safety.Limits(20, 0, "drop", period_ns=DAY * 10**6), "select ts_ns, line from e where k <= 20"),
    "sample": (safety.Limits(20, 25, "sample", "drop", DAY * 10**6, 2, 2), "select ts_ns, line from e where k <= 20 or (k <= 25 and (k - 20 <= 2 or (k - 20) % 2 = 0))"),
    "truncate": (safety.Limits(20, 0, "truncate", period_ns=DAY * 10**6, window_ns=DAY * 10**6), "select ts_ns, line from e where k <= 20 union all select min(ts_ns), count(*) || ' suppressed' from e where k > 20 group by d"),
    "compact": (safety.Limits(5, 0, "compact", period_ns=DAY * 10**6, window_ns=DAY * 10**6, compact_threshold=2), ", c as (select *, row_number() over (partition by d, line order by ts_ns) as r from e where k > 5) select ts_ns, line from e where k <= 5 union all select ts_ns, line from c where r < 2 union all select min(ts_ns), count(*) || ' collapsed: ' || line from c where r >= 2 group by d, line"),
}
for _key, (_limits, _sql) in _LIMITED.items():
    QUERIES[f"S23_{_key}"] = lambda spark, d, limits=_limits: safety.guard(demo.logs(spark, d), limits).select("ts_ns", "line")
    ORACLE[f"S23_{_key}"] = f"{_DAYS} {_sql}"
