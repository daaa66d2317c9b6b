"""The driver's queries: an entry for each operator, with its SQL where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import discovery
from .operators.logs import LogEngine
from .operators.profiles import SEP, ProfileEngine
from .operators.prom import PromEngine
from .operators.traces import TraceEngine
from .sources import demo

DAY = 86_400_000
START, END = 1_704_153_600_000, 1_706_659_200_000  # 2024-01-02 .. 2024-01-31: every event is in a window of the last day
Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _flat(df: DataFrame, labels: tuple[str, ...], value: str = "value") -> DataFrame:
    names = {"__name__": "name"}
    return df.select(*(F.coalesce(F.col("labels")[x], F.lit("")).alias(names.get(x, x)) for x in labels), "step_ms", F.round(value, 7).alias("value"))


def _prom(key: str, query: str, labels: tuple[str, ...], sql: str | None, step: int = DAY) -> None:
    QUERIES[key] = lambda spark, d: _flat(PromEngine(demo.metrics(spark, d)).query_range(query, START, END, step), labels)
    if sql:
        ORACLE[key] = f"with {_SAMPLES.format(step=step)} {sql}"


_SAMPLES = f"""
grid as (select range as t from range({START}, {END} + 1, {{step}})),
s as (select event_type as n, cast(user_id as varchar) as u, epoch_us(ts) // 1000 as ts, value as v from events),
l as (select *, lag(ts) over (partition by n, u order by ts) as pts, lag(v) over (partition by n, u order by ts) as pv from s)"""


def _window(days: float) -> str:
    w = int(days * DAY)
    return f", w as (select n, u, t, ts, v, case when pts > t - {w} then pts end as pts, case when pts > t - {w} then pv end as pv from l join grid on ts > t - {w} and ts <= t)"


W = _window(2)
_BASE = f"""{W}, b as (select n, u, t, count(*) as c, arg_min(v, ts) as fv, arg_max(v, ts) as lv, min(ts) as ft, max(ts) as lt,
 coalesce(sum(case when pv > v then pv end), 0) as rs from w group by all)"""


def _extrapolated(counter: bool, rate: bool) -> str:
    zero = "case when d > 0 and fv >= 0 then least(bf, took * fv / d) else bf end" if counter else "bf"
    return f"""{_BASE}, e as (select *, lv - fv {'+ rs' if counter else ''} as d, (lt - ft) / 1000.0 as took, (lt - ft) / 1000.0 / (c - 1) as gap, (ft - (t - {2 * DAY})) / 1000.0 as b0, (t - lt) / 1000.0 as a0 from b where c > 1),
 f as (select *, case when b0 >= gap * 1.1 then gap / 2 else b0 end as bf, case when a0 >= gap * 1.1 then gap / 2 else a0 end as af from e)
 select u as "user", t as step_ms, round(d * ((took + {zero} + af) / took) {'/ ' + str(2 * DAY / 1000) if rate else ''}, 7) as value from f where n = 'view'"""


_AGG = {
    "R1_count_over_time": "count(*)::double", "R2_sum_over_time": "sum(v)", "R3_avg_over_time": "avg(v)", "R4_min_over_time": "min(v)", "R5_max_over_time": "max(v)", "R6_last_over_time": "arg_max(v, ts)", "R7_first_over_time": "arg_min(v, ts)",
    "R8_present_over_time": "1.0::double", "R9_stddev_over_time": "stddev_pop(v)", "R10_stdvar_over_time": "var_pop(v)", "R16_changes": "count(case when pv <> v then 1 end)::double", "R17_resets": "count(case when pv > v then 1 end)::double",
    "R22_ts_of_first_over_time": "min(ts) / 1000.0", "R22_ts_of_last_over_time": "max(ts) / 1000.0", "R23_ts_of_max_over_time": "arg_max(ts, v) / 1000.0", "R23_ts_of_min_over_time": "arg_min(ts, v) / 1000.0",
}
for _key, _sql in _AGG.items():
    _prom(_key, f"{_key.split('_', 1)[1]}(view[2d])", ("user",), f"""{W} select u as "user", t as step_ms, round({_sql}, 7) as value from w where n = 'view' group by u, t""")
_prom("R20_quantile_over_time", "quantile_over_time(0.9, view[2d])", ("user",), f"""{W} select u as "user", t as step_ms, round(quantile_cont(v, 0.9), 7) as value from w where n = 'view' group by u, t""")
_prom("R21_mad_over_time", "mad_over_time(view[2d])", ("user",), f"""{W} select u as "user", t as step_ms, round(mad(v), 7) as value from w where n = 'view' group by u, t""")
_prom("R11_rate", "rate(view[2d]) * 1000", ("user",), _extrapolated(True, True).replace(f"/ {2 * DAY / 1000}, 7)", f"/ {2 * DAY / 1000} * 1000, 7)"))
_prom("R12_increase", "increase(view[2d])", ("user",), _extrapolated(True, False))
_prom("R13_delta", "delta(view[2d])", ("user",), _extrapolated(False, False))
_LAST = f"""{W}, r as (select u, t, arg_max(v, ts) as v, max(ts) as ts, max_by(pts, ts) as pts0, count(*) as c, list(struct_pack(ts := ts, v := v) order by ts) as q from w where n = 'view' group by u, t)"""
_prom("R14_irate", "irate(view[2d]) * 1000", ("user",), f"""{_LAST} select u as "user", t as step_ms, round((case when q[-1].v < q[-2].v then q[-1].v else q[-1].v - q[-2].v end) / ((q[-1].ts - q[-2].ts) / 1000.0) * 1000, 7) as value from r where c > 1""")
_prom("R15_idelta", "idelta(view[2d])", ("user",), f"""{_LAST} select u as "user", t as step_ms, round(q[-1].v - q[-2].v, 7) as value from r where c > 1""")
_prom("R18_deriv", "deriv(view[2d]) * 1000", ("user",), f"""{W} select u as "user", t as step_ms, round(1000 * regr_slope(v, (ts - t) / 1000.0), 7) as value from w where n = 'view' group by u, t having count(*) > 1""")
_prom("R19_predict_linear", "predict_linear(view[2d], 3600)", ("user",), f"""{W} select u as "user", t as step_ms, round(regr_intercept(v, (ts - t) / 1000.0) + 3600 * regr_slope(v, (ts - t) / 1000.0), 7) as value from w where n = 'view' group by u, t having count(*) > 1""")
_prom("R24_absent_over_time", 'absent_over_time(view{user="7"}[3h])', ("user",), f"""{_window(0.125)} select '7' as "user", t as step_ms, 1.0::double as value from grid where t not in (select t from w where n = 'view' and u = '7')""")
_prom("R25_subquery", "max_over_time(sum(count_over_time(view[6h]))[1d:6h])", (), f""", i as (select range as t from range({START - DAY}, {END} + 1, {DAY // 4})), c as (select t, count(*)::double as v from s join i on ts > t - {DAY // 4} and ts <= t where n = 'view' group by t)
 select grid.t as step_ms, round(max(v), 7) as value from c join grid on c.t > grid.t - {DAY} and c.t <= grid.t group by grid.t""")

_LB = f", i as (select n, u, t, arg_max(v, ts) as v, max(ts) as ts from s join grid on ts > t - {300_000} and ts <= t group by n, u, t)"
_prom("J19_lookback", "{__name__=~\"view|click\"}", ("__name__", "user"), f"""{_LB} select n as name, u as "user", t as step_ms, round(v, 7) as value from i where n in ('view', 'click')""", 600_000)
_L = """{W}, m as (select n, u, t, sum(v) as v from w group by n, u, t)""".replace("{W}", W)
_SUM = 'sum_over_time({__name__=~".+"}[2d])'
_V, _C = "sum_over_time(view[2d])", "sum_over_time(click[2d])"
for _op, _fn in {"sum": "sum(v)", "avg": "avg(v)", "min": "min(v)", "max": "max(v)", "count": "count(*)::double", "group": "1.0::double", "stddev": "stddev_pop(v)", "stdvar": "var_pop(v)"}.items():
    _prom(f"A_{_op}", f"{_op}(sum_over_time(view[2d]))", (), f"{_L} select t as step_ms, round({_fn}, 7) as value from m where n = 'view' group by t")
_prom("A7_by", 'sum by (__name__) (last_over_time({__name__!=""}[2d]))', ("__name__",), f"{_BASE} select n as name, t as step_ms, round(sum(lv), 7) as value from b group by n, t")
_prom("A7_without", "sum without (user) (sum_over_time(view[2d]))", (), f"{_L} select t as step_ms, round(sum(v), 7) as value from m where n = 'view' group by t")
_prom("A8_topk", "topk(3, sum_over_time(view[2d]))", ("user",), f"""{_L} select u as "user", t as step_ms, round(v, 7) as value from (select *, row_number() over (partition by t order by v desc) as k from m where n = 'view') where k <= 3""")
_prom("A8_bottomk", "bottomk(3, sum_over_time(view[2d]))", ("user",), f"""{_L} select u as "user", t as step_ms, round(v, 7) as value from (select *, row_number() over (partition by t order by v) as k from m where n = 'view') where k <= 3""")
_prom("A10_limit_ratio", "count(limit_ratio(0.5, sum_over_time(view[2d]))) + count(limit_ratio(-0.5, sum_over_time(view[2d])))", (), f"{_L} select t as step_ms, count(*)::double as value from m where n = 'view' group by t")
_prom("A11_quantile", "quantile(0.25, sum_over_time(view[2d]))", (), f"{_L} select t as step_ms, round(quantile_cont(v, 0.25), 7) as value from m where n = 'view' group by t")
_prom("A12_count_values", 'count_values("n", count_over_time(view[2d]))', ("n",), f"""{_BASE} select cast(c as varchar) as n, t as step_ms, count(*)::double as value from b where n = 'view' group by b.c, t""")
_JOIN = f"""{_L}, a as (select u, t, v from m where n = 'view'), b as (select u, t, v as o from m where n = 'click')"""
for _op in ("+", "-", "*", "/"):
    _prom(f"J1_{ {'+': 'add', '-': 'sub', '*': 'mul', '/': 'div'}[_op]}", f"{_V} {_op} {_C}", ("user",), f"""{_JOIN} select u as "user", t as step_ms, round(v {_op} o, 7) as value from a join b using (u, t)""")
_prom("J2_on", f"{_V} - on (user) {_C}", ("user",), f"""{_JOIN} select u as "user", t as step_ms, round(v - o, 7) as value from a join b using (u, t)""")
_prom("J3_group_left_share", "sum_over_time(view[2d]) / on () group_left sum(sum_over_time(view[2d]))", ("user",), f"""{_L} select u as "user", t as step_ms, round(v / sum(v) over (partition by t), 7) as value from m where n = 'view'""")
_prom("J4_and", f"{_V} and {_C}", ("user",), f"""{_JOIN} select u as "user", t as step_ms, round(v, 7) as value from a semi join b using (u, t)""")
_prom("J4_unless", f"{_V} unless {_C}", ("user",), f"""{_JOIN} select u as "user", t as step_ms, round(v, 7) as value from a anti join b using (u, t)""")
_prom("J4_or", f"{_V} or {_C}", ("user",), f"""{_JOIN} select u as "user", t as step_ms, round(v, 7) as value from (select u, t, v from a union all select u, t, o from b anti join a using (u, t))""")
_prom("J5_filter", f"{_V} > 100", ("user",), f"""{_L} select u as "user", t as step_ms, round(v, 7) as value from m where n = 'view' and v > 100""")
_prom("J5_bool", f"{_V} > bool 100", ("user",), f"""{_L} select u as "user", t as step_ms, (v > 100)::double as value from m where n = 'view'""")
_prom("J6_scalars", "vector(time() % 7 + 2 ^ 3)", (), " select t as step_ms, (t / 1000.0) % 7 + 8 as value from grid")
for _fn, _sql in {"abs": "abs(v)", "ceil": "ceil(v)", "floor": "floor(v)", "sqrt": "sqrt(v)", "ln": "ln(v)", "log2": "log2(v)", "log10": "log10(v)", "sgn": "sign(v)::double", "sin": "sin(v)", "cos": "cos(v)", "atan": "atan(v)", "deg": "degrees(v)", "rad": "radians(v)", "clamp_max": "least(v, 50.0)", "clamp_min": "greatest(v, 50.0)", "round": "floor(v + 0.5)"}.items():
    _arg = ", 50" if _fn.startswith("clamp") else ""
    _prom(f"I_{_fn}", f"{_fn}({_V}{_arg})", ("user",), f"""{_L} select u as "user", t as step_ms, round({_sql}, 7) as value from m where n = 'view'""")
_prom("I6_timestamp", 'timestamp({__name__="view"})', ("user",), f"""{_LB} select u as "user", t as step_ms, round(ts / 1000.0, 7) as value from i where n = 'view'""", 600_000)
_prom("I7_scalar", f"vector(scalar(sum({_V})))", (), f"{_L} select grid.t as step_ms, round(coalesce(x.v, 'nan'::double), 7) as value from grid left join (select t, sum(v) as v from m where n = 'view' group by t) x using (t)")
_prom("I8_label_replace", f'label_replace({_V}, "first", "d$1", "user", "(.).*")', ("user", "first"), f"""{_L} select u as "user", 'd' || left(u, 1) as "first", t as step_ms, round(v, 7) as value from m where n = 'view'""")
_prom("I9_label_join", f'label_join({_V}, "both", "-", "user", "user")', ("both",), f"""{_L} select u || '-' || u as "both", t as step_ms, round(v, 7) as value from m where n = 'view'""")
_prom("I10_absent", 'absent(view{user="7"})', ("user",), f"""{_LB} select '7' as "user", t as step_ms, 1.0::double as value from grid where t not in (select t from i where n = 'view' and u = '7')""")
for _fn, _sql in {"day_of_month": "day(x)", "day_of_week": "dayofweek(x)", "day_of_year": "dayofyear(x)", "hour": "hour(x)", "minute": "minute(x)", "month": "month(x)", "year": "year(x)", "days_in_month": "day(last_day(x))"}.items():
    _prom(f"I11_{_fn}", f"{_fn}()", (), f" select t as step_ms, ({_sql})::double as value from (select t, make_timestamp(t * 1000) as x from grid)")
_prom("I12_minus", f"-{_V}", ("user",), f"""{_L} select u as "user", t as step_ms, round(-v, 7) as value from m where n = 'view'""")
_prom("I13_offset", "sum_over_time(view[1d] offset 1d)", ("user",), f""", w as (select u, t, v from s join grid on ts > t - {2 * DAY} and ts <= t - {DAY} where n = 'view') select u as "user", t as step_ms, round(sum(v), 7) as value from w group by u, t""")
_prom("O1_sort", f"sort({_V})", ("user",), f"""{_L} select u as "user", t as step_ms, round(v, 7) as value from m where n = 'view'""")


# logs

def _logql(key: str, query: str, labels: tuple[str, ...], sql: str | None, source=demo.logs, start: int = START, end: int = END, step: int = DAY) -> None:
    QUERIES[key] = lambda spark, d: _flat(LogEngine(source(spark, d)).query_range(query, start * 10**6, (end - step) * 10**6, step), labels)
    if sql:
        ORACLE[key] = sql


_E = f"""with grid as (select range as t from range({START}, {END} + 1, {DAY})), e as (select event_type as n, user_id as u, epoch_us(ts) as us, props, (props->>'k')::double as k, value as v from events),
w as (select * from e join grid on us > (t - {DAY}) * 1000 and us <= t * 1000)"""
_logql("L1_count_over_time", 'sum by (event_type) (count_over_time({event_type=~"click|view"} | json | k > 10 [1d]))', ("event_type",), f"{_E} select n as event_type, t as step_ms, count(*)::double as value from w where n in ('click', 'view') and k > 10 group by n, t")
for _fn, _sql in {"sum_over_time": "sum(k)", "avg_over_time": "avg(k)", "min_over_time": "min(k)", "max_over_time": "max(k)", "stddev_over_time": "stddev_pop(k)", "stdvar_over_time": "var_pop(k)", "first_over_time": "arg_min(k, us)", "last_over_time": "arg_max(k, us)"}.items():
    _logql(f"L_{_fn}", f'{_fn}({{event_type="view"}} | json | unwrap k [1d]) by (event_type)', ("event_type",), f"{_E} select n as event_type, t as step_ms, round({_sql}, 7) as value from w where n = 'view' group by n, t")
_logql("L7_quantile_over_time", 'quantile_over_time(0.75, {event_type="view"} | json | unwrap k [1d]) by (event_type)', ("event_type",), f"{_E} select n as event_type, t as step_ms, round(quantile_cont(k, 0.75), 7) as value from w where n = 'view' group by n, t")
_logql("L2_rate", 'sum by (event_type) (rate({event_type!="error"}[1d])) * 1000', ("event_type",), f"{_E} select n as event_type, t as step_ms, round(count(*) / {DAY / 1000} * 1000, 7) as value from w where n <> 'error' group by n, t")
_logql("L3_bytes_over_time", 'sum by (event_type) (bytes_over_time({event_type="view"}[1d]))', ("event_type",), f"{_E} select n as event_type, t as step_ms, sum(strlen(props))::double as value from w where n = 'view' group by n, t")
_logql("L9_absent_over_time", 'absent_over_time({event_type="view", user="3"}[1d])', ("event_type", "user"), f"""{_E} select 'view' as event_type, '3' as "user", t as step_ms, 1.0::double as value from grid where t not in (select t from w where n = 'view' and u = 3)""")
_logql("J8_ratio", 'sum(count_over_time({event_type="view"}[1d])) / sum(count_over_time({event_type="click"}[1d]))', (), f"{_E} select t as step_ms, round(a / b, 7) as value from (select t, count(case when n = 'view' then 1 end)::double as a, count(case when n = 'click' then 1 end)::double as b from w group by t) where a > 0 and b > 0")


def _lines(key: str, query: str, columns: tuple[str, ...], sql: str | None, source=demo.access_logs) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return LogEngine(source(spark, d)).lines(query, 0, 1 << 62, columns)

    QUERIES[key] = run
    if sql:
        ORACLE[key] = sql


_O = """with o as (select o_orderkey * 1000000000 as ts_ns, o_orderstatus as st, o_orderpriority as pr, o_custkey as cu, o_orderkey % 900 as took, '10.0.' || (o_custkey % 4) || '.' || (o_orderkey % 250) as ip,
 'status=' || o_orderstatus || ' prio="' || o_orderpriority || '" cust=' || o_custkey || ' took=' || (o_orderkey % 900) || 'ms ip=10.0.' || (o_custkey % 4) || '.' || (o_orderkey % 250) as line from orders)"""
_lines("F4_contains", '{job="orders"} |= "URGENT" != "status=F"', ("status",), f"{_O} select ts_ns, line, st as status from o where line like '%URGENT%' and line not like '%status=F%'")
_lines("F5_regex", '{job="orders"} |~ "cust=1[0-9]+ "', ("status",), f"{_O} select ts_ns, line, st as status from o where regexp_matches(line, 'cust=1[0-9]+ ')")
_lines("F6_or", '{job="orders"} |= "HIGH" or "LOW"', ("status",), f"{_O} select ts_ns, line, st as status from o where line like '%HIGH%' or line like '%LOW%'")
_lines("F7_ip", '{job="orders"} |= ip("10.0.2.0/24")', ("status",), f"{_O} select ts_ns, line, st as status from o where ip like '10.0.2.%'")
_lines("F8_wildcard", '{job="orders"} |> "status=O<_>cust=<_>"', ("status",), f"{_O} select ts_ns, line, st as status from o where line like '%status=O%cust=%'")
_lines("F9_label_string", '{job="orders"} | status =~ "O|F"', ("status",), f"{_O} select ts_ns, line, st as status from o where st in ('O', 'F')")
_lines("F10_number", '{job="orders"} | logfmt | cust >= 700', ("cust", "prio"), f"{_O} select ts_ns, line, cu::varchar as cust, pr as prio from o where cu >= 700")
_lines("F11_duration", '{job="orders"} | logfmt | took > 500ms', ("took",), f"{_O} select ts_ns, line, took || 'ms' as took from o where took > 500")
_lines("F13_label_ip", '{job="orders"} | logfmt | ip = ip("10.0.1.10-10.0.1.90")', ("ip",), f"{_O} select ts_ns, line, ip from o where ip like '10.0.1.%' and split_part(ip, '.', 4)::int between 10 and 90")
_lines("F14_and_or", '{job="orders"} | logfmt | cust < 100 and took > 100ms or prio = "5-LOW"', ("cust",), f"{_O} select ts_ns, line, cu::varchar as cust from o where (cu < 100 and took > 100) or pr = '5-LOW'")
_lines("F15_distinct", '{job="orders"} | logfmt | distinct prio', ("prio",), f"{_O} select ts_ns, line, pr as prio from (select *, row_number() over (partition by pr order by ts_ns) as n from o) where n = 1")
_lines("F16_drop", '{job="orders"} | drop status="F", job', ("job", "status"), f"{_O} select ts_ns, line, '' as job, case when st = 'F' then '' else st end as status from o")
_lines("F17_keep", '{job="orders"} | keep job', ("job", "status"), f"{_O} select ts_ns, line, 'orders' as job, '' as status from o")
_lines("F18_rename", '{job="orders"} | label_format state=status', ("state", "status"), f"{_O} select ts_ns, line, st as state, '' as status from o")
_lines("F19_label_template", '{job="orders"} | logfmt | label_format x="{{.status | ToLower}}-{{ add .cust 1 }}"', ("x",), f"{_O} select ts_ns, line, lower(st) || '-' || (cu + 1) as x from o")
_lines("F20_line_format", '{job="orders"} | logfmt | line_format "{{.cust}} {{ trunc 3 .prio }}"', ("status",), f"{_O} select ts_ns, cu || ' ' || left(pr, 3) as line, st as status from o")
_lines("F22_json", '{event_type="view"} | json', ("k",), "select epoch_us(ts) * 1000 as ts_ns, props as line, props->>'k' as k from events where event_type = 'view'", demo.logs)
_lines("F23_json_path", '{event_type="view"} | json x="k"', ("x",), "select epoch_us(ts) * 1000 as ts_ns, props as line, props->>'k' as x from events where event_type = 'view'", demo.logs)
_lines("F24_logfmt", '{job="orders"} | logfmt p="prio"', ("p",), f"{_O} select ts_ns, line, pr as p from o")
_lines("F25_regexp", '{job="orders"} | regexp "cust=(?P<who>[0-9]+)"', ("who",), f"{_O} select ts_ns, line, cu::varchar as who from o")
_lines("F26_pattern", '{job="orders"} | pattern "status=<s> prio=<_> cust=<c> took"', ("s", "c"), f"{_O} select ts_ns, line, st as s, regexp_extract(line, 'status=(.*?) prio=(.*?) cust=(.*?) took', 3) as c from o")
_lines("F27_unpack", '{event_type="view"} | unpack', ("k",), "select epoch_us(ts) * 1000 as ts_ns, props as line, props->>'k' as k from events where event_type = 'view'", demo.logs)


# traces

def _trace(key: str, query: str, sql: str | None) -> None:
    QUERIES[key] = lambda spark, d: TraceEngine(demo.spans(spark, d)).select(query).select("trace_id", "span_id", "name", "duration_ns")
    if sql:
        ORACLE[key] = f"{_SP} select tid as trace_id, sid as span_id, name, dur as duration_ns from {sql}"


_SP = """with p as (select conv_id as c, turn as k, lower(printf('%032x', conv_id)) as tid, lower(printf('%016x', turn + 1)) as sid, 'turn-' || role as name, role, length(text) as chars, length(text)::bigint * 1000 as dur,
 case when length(text) % 7 = 0 then 'error' else 'ok' end as st, count(*) over (partition by conv_id) as n from conversations where conv_id is not null and turn is not null)"""
_trace("F30_filter", '{ .chars > 300 && resource.service.name = "user" }', "p where chars > 300 and role = 'user'")
_trace("F31_scalar", "{ } | count() > 5", "p where n > 5")
_trace("T5_regex", '{ name =~ "assist" }', "p where name like '%assist%'")
_trace("T7_status", "{ status = error && duration > 100us }", "p where st = 'error' and dur > 100000")
_trace("T8_root", "{ parent = nil }", "p where k = 0")
_trace("T9_root_name", '{ rootName = "turn-user" && kind = server }', "p where role <> 'user' and c in (select c from p where k = 0 and role = 'user')")
_trace("T2_math", "{ .chars * 2 + 1 > 801 }", "p where chars * 2 + 1 > 801")
_trace("T4_missing", '{ .missing != "x" }', "p")
_trace("T14_child_count", "{ childCount = 0 }", "p a where not exists (select 1 from p b where b.c = a.c and b.k = a.k + 1)")
_trace("J12_and", "{ status = error } && { .turn = 3 }", "p where (st = 'error' or k = 3) and c in (select c from p where st = 'error') and c in (select c from p where k = 3)")
_trace("J13_or", "{ status = error } || { .turn = 3 }", "p where st = 'error' or k = 3")
_trace("J14_child", '{ status = error } > { name =~ ".+" }', "p a where exists (select 1 from p b where b.c = a.c and b.k = a.k - 1 and b.st = 'error')")
_trace("J15_descendant", "{ .turn = 1 } >> { .turn > 0 }", "p a where k > 1 and exists (select 1 from p b where b.c = a.c and b.k = 1)")
_trace("J16_sibling", "{ status = error } ~ { }", "p a where st = 'error'")
_trace("J17_parent", "{ .turn > 0 } < { status = error }", "p a where st = 'error' and exists (select 1 from p b where b.c = a.c and b.k = a.k + 1)")
_trace("J17_not_child", "{ status = error } !> { .turn > 0 }", "p a where k > 0 and not exists (select 1 from p b where b.c = a.c and b.k = a.k - 1 and b.st = 'error')")
_trace("A15_avg", "{ } | avg(.chars) > 200", "p where c in (select c from p group by c having avg(chars) > 200)")
_trace("F33_by", "{ } | by(name) | count() > 3", "p where (c, name) in (select (c, name) from p group by c, name having count(*) > 3)")


def _search(spark: SparkSession, d: str) -> DataFrame:
    return TraceEngine(demo.spans(spark, d)).search("{ status = error }", 20).select("trace_id", "root_name", "matched")


QUERIES["O7_search"] = _search
ORACLE["O7_search"] = f"{_SP} select tid as trace_id, max(case when k = 0 then name end) as root_name, count(case when st = 'error' then 1 end) as matched from p where c in (select c from p where st = 'error') group by tid, c order by c limit 20"

# profiles
_P = "with q as (select string_split(p_type, ' ') as s, p_size::bigint as v, p_brand, p_partkey from part)"


def _profile(key: str, run: Callable[[ProfileEngine], DataFrame], sql: str | None) -> None:
    QUERIES[key] = lambda spark, d: run(ProfileEngine(demo.profiles(spark, d)))
    if sql:
        ORACLE[key] = sql


CPU = "cpu:cpu:nanoseconds:cpu:nanoseconds"
_profile("P2_tree", lambda e: e.tree(CPU).select(F.translate("path", SEP, ";").alias("path"), "depth", "self", "total"), f"""{_P}, x as (select array_to_string(s[1:d], ';') as path, d as depth, case when d = len(s) then v else 0 end as own, v from (select s, v, unnest(range(0, len(s) + 1)) as d from q))
 select path, depth::int as depth, sum(own)::bigint as "self", sum(v)::bigint as total from x group by path, depth""")
_profile("P1_selector", lambda e: e.collapsed(CPU + '{service_name=~"Brand#1.*"}'), f"{_P} select array_to_string(s, ';') as stack, sum(v)::bigint as value from q where p_brand like 'Brand#1%' group by 1")
_profile("P7_labels", lambda e: e.label_values("service_name"), f"{_P} select distinct p_brand as value from q")

# metadata
QUERIES["M2_label_values"] = lambda spark, d: discovery.label_values(demo.metrics(spark, d), "__name__")
ORACLE["M2_label_values"] = "select distinct event_type as value from events"
QUERIES["M3_series"] = lambda spark, d: discovery.series(demo.metrics(spark, d), [[("__name__", "=", "view")]]).select(F.col("labels")["__name__"].alias("name"), F.col("labels")["user"].alias("user"))
ORACLE["M3_series"] = """select distinct event_type as name, user_id::varchar as "user" from events where event_type = 'view'"""
QUERIES["M9_detected_labels"] = lambda spark, d: discovery.detected_labels(demo.logs(spark, d)).select("name")
ORACLE["M9_detected_labels"] = "select unnest(['event_type', 'user']) as name"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["L1_count_over_time"](spark, sf_dir)


from . import forms  # noqa: E402, F401  registers further forms
