"""PromQL over Spark: each node of the tree becomes a DataFrame.

A vector is (labels MAP, step_ms, value) with a row for each series and step that has a value; a scalar is
(step_ms, value). Samples are (labels, ts_ms, value[, stale]). A window is a fan-out of samples to steps
followed by one hash aggregation by series and step; what depends on neighbours (rate, changes, ...) comes
from one lag over each series before the fan-out, on the same partitioning, so it is not shuffled twice.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import numbers as N
from ..plans import promql as P
from ..plans.lexer import QueryError
from . import native, sliding
from .grid import Grid

#: Windows that overlap as often as this are reduced in chunks (see ``sliding``); others by a fan-out and a hash aggregate.
OVERLAP = 8
LOOKBACK = 300_000
SUBQUERY_STEP = 60_000
SET_OPS = {"and", "or", "unless"}
COMPARISONS = {"==", "!=", ">", "<", ">=", "<="}

MATH = {
    "abs": F.abs, "ceil": lambda v: F.ceil(v).cast("double"), "floor": lambda v: F.floor(v).cast("double"), "exp": F.exp, "sqrt": F.sqrt, "sgn": F.signum,
    "ln": lambda v: N.log("ln", v), "log2": lambda v: N.log("log2", v), "log10": lambda v: N.log("log10", v),
    "acos": F.acos, "acosh": F.acosh, "asin": F.asin, "asinh": F.asinh, "atan": F.atan, "atanh": F.atanh, "cos": F.cos, "cosh": F.cosh,
    "sin": F.sin, "sinh": F.sinh, "tan": F.tan, "tanh": F.tanh, "deg": F.degrees, "rad": F.radians,
}


def _time(v: Column) -> Column:
    return F.timestamp_seconds(v.cast("long"))


DATES = {
    "year": lambda v: F.year(_time(v)), "month": lambda v: F.month(_time(v)), "day_of_month": lambda v: F.dayofmonth(_time(v)), "day_of_year": lambda v: F.dayofyear(_time(v)),
    "day_of_week": lambda v: F.dayofweek(_time(v)) - 1, "hour": lambda v: F.hour(_time(v)), "minute": lambda v: F.minute(_time(v)), "days_in_month": lambda v: F.dayofmonth(F.last_day(_time(v))),
}


@dataclass(frozen=True)
class Value:
    df: DataFrame
    scalar: bool = False
    constant: float | None = None
    unique: bool = False  # no two series of a step have the same labels
    one_name: bool = False  # nor would they without their metric name


def _window_functions(window: int) -> dict:
    """Aggregates over (ts_ms, value, p_ts, p_value, step_ms); p_: the sample before in the series."""
    v, ts, t = F.col("value"), F.col("ts_ms"), F.col("step_ms")
    inside = F.col("p_ts") > t - window  # the sample before is in the window too
    first, last, n = F.min_by("value", "ts_ms"), F.max_by("value", "ts_ms"), F.count("*")
    first_ts, last_ts = F.min("ts_ms"), F.max("ts_ms")
    fell = inside & N.compare(">", F.col("p_value"), v)  # with NaN nothing falls
    resets = F.sum(F.when(fell, F.col("p_value")).otherwise(0.0))

    def extrapolated(counter: bool, rate: bool) -> Column:
        moved = last - first + (resets if counter else 0)
        took = (last_ts - first_ts) / 1000.0
        gap = took / F.when(n > 1, n - 1)
        before, after = (first_ts - (F.max("step_ms") - window)) / 1000.0, (F.max("step_ms") - last_ts) / 1000.0
        before = F.when(before >= gap * 1.1, gap / 2).otherwise(before)
        if counter:
            zero = F.when((moved > 0) & (first >= 0), took * (first / F.when(moved > 0, moved))).otherwise(before)
            before = F.least(before, zero)
        after = F.when(after >= gap * 1.1, gap / 2).otherwise(after)
        out = moved * ((took + before + after) / F.when(took > 0, took))
        return F.when(n > 1, out / (window / 1000.0) if rate else out)

    tail = F.max_by(F.struct("value", "ts_ms", "p_ts", "p_value", inside.alias("two")), "ts_ms")

    def instant(counter: bool) -> Column:
        step = F.when(N.compare("<", tail["value"], tail["p_value"]) & F.lit(counter), tail["value"]).otherwise(tail["value"] - tail["p_value"])
        took = (tail["ts_ms"] - tail["p_ts"]) / 1000.0
        return F.when(F.coalesce(tail["two"], F.lit(False)), step / F.when(took != 0, took) if counter else step)

    x = (ts - t) / 1000.0
    slope = F.when(F.min("value") == F.max("value"), F.when(F.abs(F.max("value")) == float("inf"), N.nan()).otherwise(0.0)).otherwise(F.regr_slope("value", x))
    return {
        "count_over_time": n.cast("double"), "sum_over_time": F.sum(v), "avg_over_time": F.avg(v), "min_over_time": N.least_number(v), "max_over_time": N.most_number(v),
        "last_over_time": last, "first_over_time": first, "present_over_time": F.max(F.lit(1.0)), "stddev_over_time": F.stddev_pop(v), "stdvar_over_time": F.var_pop(v),
        "rate": extrapolated(True, True), "increase": extrapolated(True, False), "delta": extrapolated(False, False), "irate": instant(True), "idelta": instant(False),
        "changes": F.sum(F.when(inside & (F.col("p_value") != v), 1.0).otherwise(0.0)), "resets": F.sum(F.when(fell, 1.0).otherwise(0.0)),
        "deriv": F.when(n > 1, slope),
        "ts_of_first_over_time": F.min("ts_ms") / 1000.0, "ts_of_last_over_time": F.max("ts_ms") / 1000.0,
        "ts_of_max_over_time": F.max_by("ts_ms", F.struct(F.when(~F.isnan(v), v), ts)) / 1000.0, "ts_of_min_over_time": F.max_by("ts_ms", F.struct(F.when(~F.isnan(v), -v), ts)) / 1000.0,
        "mad_over_time": F.array_sort(F.collect_list(v)),
    }


#: Aggregates that pass series on as they are.
FILTERS = {"topk", "bottomk", "limitk", "limit_ratio"}
NEIGHBOURS = {"rate", "increase", "irate", "idelta", "changes", "resets"}
#: Sums of doubles depend on their order: it is that of time, as in the reference, however the samples are partitioned.
IN_TIME = {"sum_over_time", "avg_over_time"}
KEEP_NAME = {"last_over_time", "first_over_time"}
RANGE_FUNCTIONS = {"count_over_time", "sum_over_time", "avg_over_time", "min_over_time", "max_over_time", "last_over_time", "first_over_time", "present_over_time", "stddev_over_time", "stdvar_over_time", "rate", "increase", "delta", "irate", "idelta", "changes", "resets", "deriv", "ts_of_first_over_time", "ts_of_last_over_time", "ts_of_max_over_time", "ts_of_min_over_time", "mad_over_time", "predict_linear", "quantile_over_time", "double_exponential_smoothing"}


def _named(e) -> bool:
    """Whether a selector takes series of one metric name only."""
    return isinstance(e, P.Selector) and any(name == L.NAME and op == "=" for name, op, _ in e.matchers)


def _median(sorted_: Column) -> Column:
    n = F.size(sorted_)
    return (F.get(sorted_, ((n - 1) / 2).cast("int")) + F.get(sorted_, (n / 2).cast("int"))) / 2


class PromEngine:
    """query_range and query over samples (labels MAP, ts_ms LONG, value DOUBLE[, stale BOOLEAN]).

    With a series table (series_id, labels MAP) samples have series_id in place of labels: matchers then read the
    series only, samples are joined by a long, and labels are put on after windows are reduced. Native histograms
    (see ``native``) are what histogram functions of a selector read beside classic buckets.
    """

    def __init__(self, samples: DataFrame, lookback_ms: int = LOOKBACK, series: DataFrame | None = None, histograms: DataFrame | None = None):
        self.spark: SparkSession = samples.sparkSession
        self.series, self.histograms = series, histograms
        self.samples = samples if "stale" in samples.columns else samples.withColumn("stale", F.lit(False))
        self.lookback = lookback_ms

    # entry points

    def query_range(self, query: str, start_ms: int, end_ms: int, step_ms: int) -> DataFrame:
        out = self._eval(P.parse(query), Grid(start_ms, end_ms, step_ms))
        return out.df if out.scalar or out.unique else self._no_twins(out)

    def query(self, query: str, at_ms: int) -> DataFrame:
        tree = P.parse(query)
        if isinstance(tree, P.Selector) and tree.range_ms:
            rows = self._select(tree, Grid(at_ms, at_ms, 1))
            return self._labelled(rows.where((F.col("ts_ms") > at_ms - tree.range_ms) & (F.col("ts_ms") <= at_ms))).select("labels", "ts_ms", "value")
        return self.query_range(query, at_ms, at_ms, 1)

    def _no_twins(self, v: Value) -> DataFrame:
        """Two series with the same labels at a step are an error."""
        df = v.df.groupBy(L.key(F.col("labels")).alias("k"), "step_ms").agg(F.any_value("labels").alias("labels"), F.max("value").alias("value"), F.count("*").alias("n"))
        twin = F.raise_error(F.lit("vector cannot contain metrics with the same labelset")).cast("double")
        return df.select("labels", "step_ms", F.when(F.col("n") > 1, twin).otherwise(F.col("value")).alias("value"))

    # selectors

    def _select(self, s: P.Selector, grid: Grid) -> DataFrame:
        """Samples of a selector (k names the series), at the time at which the grid sees them; pinned ones are handled by the caller."""
        cond = F.lit(True)
        for name, op, text in s.matchers:
            cond &= L.match(L.get(F.col("labels"), name), op, text)
        if self.series is None:
            rows = self.samples.where(cond).withColumn("k", L.key(F.col("labels")))
        else:
            rows = self.samples.join(self.series.where(cond).select("series_id"), "series_id", "left_semi").withColumnRenamed("series_id", "k")
        return rows.withColumn("ts_ms", F.col("ts_ms") + s.offset_ms)

    def _histograms(self, s, grid: Grid, made: Column) -> DataFrame | None:
        """made of the last native histogram that a selector sees at each step; None where there are none to read."""
        if self.histograms is None or not isinstance(s, P.Selector) or s.range_ms:
            return None
        cond = F.lit(True)
        for name, op, text in s.matchers:
            cond &= L.match(L.get(F.col("labels"), name), op, text)

        def run(e: P.Selector, g: Grid) -> DataFrame:
            rows = self.histograms.where(cond).withColumns({"k": L.key(F.col("labels")), "ts_ms": F.col("ts_ms") + e.offset_ms})
            columns = [c for c in rows.columns if c not in ("k", "labels")]
            last = g.fan_out(rows, self.lookback).groupBy("k", "step_ms").agg(F.max_by(F.struct(*columns), "ts_ms").alias("h"))
            out = native.buckets(last.select("k", "step_ms", "h.*")).select("k", "step_ms", made.alias("value"))
            return self._nameless(self._labelled_text(out)).select("labels", "step_ms", "value")

        return self._pinned(s, grid, run)

    def _labelled_text(self, df: DataFrame) -> DataFrame:
        return df.withColumn("labels", L.of_key(F.col("k")))

    def _labelled(self, df: DataFrame) -> DataFrame:
        """df with the labels of its series k."""
        if dict(df.dtypes)["k"] == "string":
            return self._labelled_text(df)
        return df.join(self.series.select(F.col("series_id").alias("k"), "labels"), "k")

    def _pinned(self, e, grid: Grid, evaluate) -> DataFrame:
        """With @ the window stands still: it is evaluated once and given to all steps."""
        if e.at is None:
            return evaluate(e, grid)
        at = {"start": grid.start, "end": grid.last}.get(e.at, e.at)
        one = evaluate(replace(e, at=None), Grid(at, at, 1)).drop("step_ms")
        return one.crossJoin(F.broadcast(grid.steps(self.spark)))  # steps of one query: a bounded side

    def _instant(self, s: P.Selector, grid: Grid, stamp: bool = False) -> DataFrame:
        def run(e: P.Selector, g: Grid) -> DataFrame:
            rows = g.fan_out(self._select(e, g), self.lookback)
            last = rows.groupBy("k", "step_ms").agg(F.max_by(F.struct("value", "stale", "ts_ms"), "ts_ms").alias("x")).where("not x.stale")
            value = (F.col("x.ts_ms") - e.offset_ms) / 1000.0 if stamp else F.col("x.value")
            return self._labelled(last.select("k", "step_ms", value.alias("value"))).select("labels", "step_ms", "value")

        return self._pinned(s, grid, run)

    def _range(self, name: str, e, grid: Grid, args: list[float]) -> DataFrame:
        def run(e, g: Grid) -> DataFrame:
            window = e.range_ms
            if isinstance(e, P.Subquery):
                step = e.step_ms or SUBQUERY_STEP
                low, high = g.start - e.offset_ms - window, g.last - e.offset_ms
                inner = Grid((low // step + 1) * step, high, step)
                rows = self._vector(self._eval(e.expr, inner), inner).withColumnRenamed("step_ms", "ts_ms").withColumn("ts_ms", F.col("ts_ms") + e.offset_ms).withColumn("k", L.key(F.col("labels")))
            else:
                rows = self._select(e, g).where("not stale")
            rows = rows.where((F.col("ts_ms") > g.start - window) & (F.col("ts_ms") <= g.last)).select("k", "ts_ms", "value")
            if min(window, g.last + g.step - g.start) >= OVERLAP * g.step and name in sliding.FUNCTIONS:
                out = self._labelled(sliding.over_time(rows, g, window, name)).select("labels", F.explode(F.arrays_zip("step_ms", "value")).alias("x")).select("labels", "x.step_ms", "x.value")
                return out if name in KEEP_NAME else self._nameless(out)
            if name in NEIGHBOURS:
                before = Window.partitionBy("k").orderBy("ts_ms")
                rows = rows.withColumns({"p_ts": F.lag("ts_ms").over(before), "p_value": F.lag("value").over(before)})
            else:
                rows = rows.withColumns({"p_ts": F.lit(None).cast("long"), "p_value": F.lit(None).cast("double")})
            out = g.fan_out(rows, window)
            if name in IN_TIME:
                out = out.repartition("k", "step_ms").sortWithinPartitions("k", "step_ms", "ts_ms", "value")
            grouped = out.groupBy("k", "step_ms")
            v, x = F.col("value"), (F.col("ts_ms") - F.col("step_ms")) / 1000.0
            if name == "quantile_over_time":
                made = N.quantile(args[0], v)
            elif name == "predict_linear":
                flat = F.min("value") == F.max("value")
                made = F.when(F.count("*") > 1, F.when(flat, F.max("value")).otherwise(F.regr_intercept("value", x) + F.regr_slope("value", x) * args[0]))
            elif name == "double_exponential_smoothing":
                made = _smoothed(F.transform(F.array_sort(F.collect_list(F.struct("ts_ms", "value"))), lambda s: s["value"]), *args)
            else:
                made = _window_functions(window)[name]
            out = self._labelled(grouped.agg(made.alias("value")))
            if name == "mad_over_time":
                out = out.withColumn("value", _median(F.array_sort(F.transform("value", lambda y: F.abs(y - _median(F.col("value")))))))
            if name not in KEEP_NAME:
                out = out.withColumn("labels", L.drop(F.col("labels"), [L.NAME]))
            return out.where("value is not null").select("labels", "step_ms", "value")

        return self._pinned(e, grid, run)

    # nodes

    def _eval(self, e, grid: Grid) -> Value:
        if isinstance(e, P.Number):
            return Value(grid.steps(self.spark).withColumn("value", F.lit(e.value)), True, e.value)
        if isinstance(e, P.Text):
            raise QueryError("a string stands only as an argument")
        if isinstance(e, P.Selector):
            if e.range_ms:
                raise QueryError("a range needs a function")
            return Value(self._instant(e, grid), unique=True, one_name=_named(e))
        if isinstance(e, P.Unary):
            v = self._eval(e.expr, grid)
            df = v.df.withColumn("value", -F.col("value"))
            return Value(df, True, None if v.constant is None else -v.constant) if v.scalar else self._same(v, df)
        if isinstance(e, P.Aggregate):
            return Value(self._aggregate(e, grid), unique=e.op not in FILTERS, one_name=L.NAME not in (e.by or ()) and e.op not in FILTERS)
        if isinstance(e, P.Binary):
            return self._binary(e, grid)
        if isinstance(e, P.Call):
            return self._call(e, grid)
        raise QueryError(f"can't evaluate {e}")

    def _same(self, v: Value, df: DataFrame) -> Value:
        """df with the series of v, without their names."""
        return Value(self._nameless(df), unique=v.one_name, one_name=v.one_name)

    def _nameless(self, df: DataFrame) -> DataFrame:
        return df.withColumn("labels", L.drop(F.col("labels"), [L.NAME]))

    def _vector(self, v: Value, grid: Grid) -> DataFrame:
        return v.df.select(L.empty().alias("labels"), "step_ms", "value") if v.scalar else v.df

    def _number(self, e, grid: Grid) -> float:
        v = self._eval(e, grid)
        if v.constant is None:
            raise QueryError("this argument must be a number")
        return v.constant

    def _call(self, e: P.Call, grid: Grid) -> Value:
        name, args, value = e.name, e.args, F.col("value")
        if name in RANGE_FUNCTIONS:
            ranged = [a for a in args if isinstance(a, P.Subquery) or isinstance(a, P.Selector) and a.range_ms]
            if len(ranged) != 1:
                raise QueryError(f"{name} takes a range")
            single = _named(ranged[0])
            return Value(self._range(name, ranged[0], grid, [self._number(a, grid) for a in args if a is not ranged[0]]), unique=single or name in KEEP_NAME and isinstance(ranged[0], P.Selector), one_name=single)
        if name in ("absent", "absent_over_time"):
            return Value(self._absent(name, args[0], grid))
        if name == "pi":
            return Value(grid.steps(self.spark).withColumn("value", F.lit(math.pi)), True, math.pi)
        if name == "time":
            return Value(grid.steps(self.spark).withColumn("value", F.col("step_ms") / 1000.0), True)
        if name == "timestamp" and isinstance(args[0], P.Selector):
            return Value(self._nameless(self._instant(args[0], grid, stamp=True)))
        if name in DATES and not args:
            return Value(grid.steps(self.spark).select(L.empty().alias("labels"), "step_ms", DATES[name](F.col("step_ms") / 1000.0).cast("double").alias("value")))
        if name == "histogram_quantile":
            q = self._number(args[0], grid)
            classic = histogram_quantile(self._eval(args[1], grid).df, q)
            found = self._histograms(args[1], grid, native.quantile(q))
            return Value(classic if found is None else classic.unionByName(found))
        if name in native.PARTS:
            found = self._histograms(args[0], grid, native.PARTS[name]())
            if found is None:
                raise QueryError(f"{name} takes a selector of native histograms")
            return Value(found)
        v = self._eval(args[0], grid)
        if name == "vector":
            return Value(self._vector(v, grid))
        if name == "scalar":
            one = v.df.groupBy("step_ms").agg(F.when(F.count("*") == 1, F.max("value")).alias("value"))
            return Value(grid.steps(self.spark).join(one, "step_ms", "left").select("step_ms", F.coalesce("value", N.nan()).alias("value")), True)
        if name == "timestamp":
            return Value(self._nameless(v.df.withColumn("value", F.col("step_ms") / 1000.0)))
        if name in ("sort", "sort_desc"):
            order = value.asc() if name == "sort" else value.desc()
            return Value(v.df.orderBy(F.isnan(value), order, L.key(F.col("labels"))))
        if name in ("sort_by_label", "sort_by_label_desc"):
            natural = [F.transform(F.regexp_extract_all(L.get(F.col("labels"), a.value), F.lit(r"\d+|\D+"), F.lit(0)), lambda x: F.when(x.rlike(r"^\d+$"), F.lpad(x, 24, "0")).otherwise(x)) for a in args[1:]]
            keys = [*natural, L.key(F.col("labels"))]
            return Value(v.df.orderBy(*(k.desc() if name.endswith("desc") else k.asc() for k in keys)))
        if name == "label_replace":
            return Value(self._label_replace(v.df, *(a.value for a in args[1:])))
        if name == "label_join":
            target, sep, *sources = (a.value for a in args[1:])
            return Value(v.df.withColumn("labels", L.put(F.col("labels"), target, F.concat_ws(sep, *(L.get(F.col("labels"), s) for s in sources)))))
        if name in ("clamp", "clamp_min", "clamp_max"):
            bounds = [self._number(a, grid) for a in args[1:]]
            low, high = {"clamp": (bounds[0], bounds[-1]), "clamp_min": (bounds[0], math.inf), "clamp_max": (-math.inf, bounds[0])}[name]
            df = v.df.where(F.lit(not low > high))
            clamped = N.nan() if math.isnan(low) or math.isnan(high) else F.when(F.isnan(value), value).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), value)))
            return self._same(v, df.withColumn("value", clamped))
        if name == "round":
            to = 1 / (self._number(args[1], grid) if len(args) > 1 else 1.0)
            return self._same(v, v.df.withColumn("value", F.when(F.isnan(value) | (F.abs(value) == float("inf")), value).otherwise(F.floor(value * to + 0.5) / to)))
        if name in MATH:
            return self._same(v, v.df.withColumn("value", MATH[name](value).cast("double")))
        if name in DATES:
            return Value(self._nameless(v.df.withColumn("value", DATES[name](value).cast("double"))))
        raise QueryError(f"unknown function {name}")

    def _label_replace(self, df: DataFrame, target: str, to: str, source: str, pattern: str) -> DataFrame:
        anchored = L.whole(pattern)
        value = L.get(F.col("labels"), source)
        made = F.regexp_replace(value, anchored, to.replace("${", "$").replace("}", "") if "${" in to else to)
        return df.withColumn("labels", F.when(value.rlike(anchored), L.put(F.col("labels"), target, made)).otherwise(F.col("labels")))

    def _absent(self, name: str, e, grid: Grid) -> DataFrame:
        if name == "absent":
            there = self._eval(e, grid).df
        else:
            there = self._range("present_over_time", e, grid, [])
        equal = {}
        for label, op, text in e.matchers if isinstance(e, P.Selector) else ():
            if op == "=" and label != L.NAME:
                equal[label] = None if label in equal else text
        flat = [F.lit(x) for k, v in equal.items() if v for x in (k, v)]
        return grid.steps(self.spark).join(there.select("step_ms").distinct(), "step_ms", "left_anti").select((F.create_map(*flat) if flat else L.empty()).alias("labels"), "step_ms", F.lit(1.0).alias("value"))

    def _group(self, e: P.Aggregate) -> Column:
        if e.without is not None:
            return L.drop(F.col("labels"), [*e.without, L.NAME])
        return L.keep(F.col("labels"), list(e.by or ()))

    def _aggregate(self, e: P.Aggregate, grid: Grid) -> DataFrame:
        df = self._eval(e.expr, grid).df.withColumn("g", self._group(e))
        v = F.col("value")
        if e.op in ("topk", "bottomk", "limitk"):
            k = self._eval(e.parameter, grid)
            order = [F.isnan(v), v.desc() if e.op == "topk" else v.asc()] if e.op != "limitk" else []
            w = Window.partitionBy(L.key(F.col("g")), "step_ms").orderBy(*order, L.key(F.col("labels")))
            ranked = df.withColumn("nth", F.row_number().over(w))
            if k.constant is not None:
                return ranked.where(F.col("nth") <= int(k.constant)).select("labels", "step_ms", "value")
            k = k.df.withColumnRenamed("value", "k")
            return ranked.join(F.broadcast(k), "step_ms").where("nth <= k").select("labels", "step_ms", "value")
        if e.op == "limit_ratio":
            r = self._number(e.parameter, grid)
            share = F.pmod(F.xxhash64(L.key(F.col("labels"))), F.lit(1 << 32)) / float(1 << 32)
            return df.where(share < r if r >= 0 else share >= 1 + r).select("labels", "step_ms", "value")
        if e.op == "count_values":
            df = df.withColumn("g", L.put(F.col("g"), e.parameter.value, N.text(v)))
            made = F.count("*").cast("double")
        elif e.op == "quantile":
            made = N.quantile(self._number(e.parameter, grid), v)
        else:
            made = {
                "sum": lambda: F.sum(v), "avg": lambda: F.avg(v), "min": lambda: N.least_number(v), "max": lambda: N.most_number(v), "count": lambda: F.count("*").cast("double"),
                "group": lambda: F.max(F.lit(1.0)), "stddev": lambda: F.stddev_pop(v), "stdvar": lambda: F.var_pop(v),
            }[e.op]()
        return df.groupBy("g", "step_ms").agg(made.alias("value")).select(F.col("g").alias("labels"), "step_ms", "value")

    # binary operators

    def _binary(self, e: P.Binary, grid: Grid) -> Value:
        a, b = self._eval(e.left, grid), self._eval(e.right, grid)
        if e.op in SET_OPS:
            return Value(self._set(e, a.df, b.df))
        comparison = e.op in COMPARISONS

        def made(x: Column, y: Column) -> Column:
            if comparison:
                return N.compare(e.op, x, y).cast("double")
            return N.arithmetic(e.op, x, y)

        if a.scalar and b.scalar:
            if comparison and not e.bool_:
                raise QueryError("comparisons of scalars need bool")
            both = a.df.withColumnRenamed("value", "x").join(b.df.withColumnRenamed("value", "y"), "step_ms")
            constant = None
            if a.constant is not None and b.constant is not None:
                constant = N.constant(e.op, a.constant, b.constant)
            return Value(both.select("step_ms", made(F.col("x"), F.col("y")).alias("value")), True, constant)
        if a.scalar or b.scalar:
            vector, other, swap = (b, a, True) if a.scalar else (a, b, False)
            if other.constant is not None:
                df = vector.df.withColumn("s", F.lit(other.constant))
            else:
                df = vector.df.join(F.broadcast(other.df.withColumnRenamed("value", "s")), "step_ms")  # a row for each step
            x, y = (F.col("s"), F.col("value")) if swap else (F.col("value"), F.col("s"))
            if comparison and not e.bool_:
                return replace(vector, df=df.where(N.compare(e.op, x, y)).select("labels", "step_ms", "value"))
            return self._same(vector, df.select("labels", "step_ms", made(x, y).alias("value")))
        return Value(self._match(e, a.df, b.df, made, comparison), unique=e.group is None, one_name=e.group is None)

    def _signature(self, e: P.Binary) -> Column:
        if e.on is not None:
            return L.keep(F.col("labels"), list(e.on))
        return L.drop(F.col("labels"), [*(e.ignoring or ()), L.NAME])

    def _match(self, e: P.Binary, a: DataFrame, b: DataFrame, made, comparison: bool) -> DataFrame:
        sig = L.key(self._signature(e))
        many, one = (b, a) if e.group == "group_right" else (a, b)

        def single(df: DataFrame) -> DataFrame:
            """One row for each signature and step, else an error."""
            per = df.withColumn("sig", sig).groupBy("sig", "step_ms").agg(F.any_value("labels").alias("labels"), F.max("value").alias("value"), F.count("*").alias("n"))
            return per.withColumn("value", F.when(F.col("n") > 1, F.raise_error(F.lit("found duplicate series for the match group")).cast("double")).otherwise(F.col("value")))

        one = single(one).select("sig", "step_ms", F.col("labels").alias("o_labels"), F.col("value").alias("o"))
        many = many.withColumn("sig", sig) if e.group else single(many)
        both = many.select("sig", "step_ms", "labels", F.col("value").alias("m")).join(one, ["sig", "step_ms"])
        x, y = (F.col("o"), F.col("m")) if e.group == "group_right" else (F.col("m"), F.col("o"))
        if comparison and not e.bool_:
            both = both.where(N.compare(e.op, x, y))
            value, labels = x, F.col("labels")
        else:
            value, labels = made(x, y), L.drop(F.col("labels"), [L.NAME])
        if not e.group and not (comparison and not e.bool_ and e.on is None and e.ignoring is None):
            labels = L.keep(F.col("labels"), list(e.on)) if e.on is not None else L.drop(labels, list(e.ignoring or ()))
        for name in e.include:
            labels = L.put(labels, name, L.get(F.col("o_labels"), name))
        return both.select(labels.alias("labels"), "step_ms", value.alias("value"))

    def _set(self, e: P.Binary, a: DataFrame, b: DataFrame) -> DataFrame:
        sig = L.key(self._signature(e))
        left, right = a.withColumn("sig", sig), b.withColumn("sig", sig)
        on = ["sig", "step_ms"]
        if e.op == "and":
            return left.join(right.select(*on), on, "left_semi").select("labels", "step_ms", "value")
        if e.op == "unless":
            return left.join(right.select(*on), on, "left_anti").select("labels", "step_ms", "value")
        rest = right.join(left.select(*on), on, "left_anti").select("labels", "step_ms", "value")
        return a.select("labels", "step_ms", "value").unionByName(rest)


def _smoothed(values: Column, sf: float, tf: float) -> Column:
    """Holt's linear smoothing; two samples at least."""
    begin = F.struct(F.get(values, F.lit(0)).alias("s"), (F.get(values, F.lit(1)) - F.get(values, F.lit(0))).alias("b"))

    def step(acc: Column, x: Column) -> Column:
        s = sf * x + (1 - sf) * (acc["s"] + acc["b"])
        return F.struct(s.alias("s"), (tf * (s - acc["s"]) + (1 - tf) * acc["b"]).alias("b"))

    return F.when(F.size(values) > 1, F.aggregate(F.slice(values, F.lit(2), F.greatest(F.lit(0), F.size(values) - 1)), begin, step, lambda acc: acc["s"]))


def histogram_quantile(df: DataFrame, q: float) -> DataFrame:
    """Of classic buckets: (labels with le, step_ms, cumulative count)."""
    le = F.col("labels")["le"]
    bound = F.when(le.isin("+Inf", "Inf"), F.lit(float("inf"))).otherwise(le.try_cast("double"))
    rows = df.withColumns({"le": bound, "labels": L.drop(F.col("labels"), ["le", L.NAME])}).where("le is not null")
    rows = rows.groupBy("labels", "step_ms").agg(F.array_sort(F.collect_list(F.struct("le", "value"))).alias("b"))
    n, b = F.size("b"), F.col("b")
    total = F.get(b, n - 1)["value"]
    rank = total * q
    k = F.size(F.filter(b, lambda x: x["value"] < rank))
    low = F.when(k > 0, F.get(b, k - 1)["le"]).otherwise(F.when(F.get(b, F.lit(0))["le"] <= 0, F.get(b, F.lit(0))["le"]).otherwise(0.0))
    below = F.when(k > 0, F.get(b, k - 1)["value"]).otherwise(0.0)
    top, count = F.get(b, k)["le"], F.get(b, k)["value"] - below
    inside = low + (top - low) * (rank - below) / F.when(count != 0, count)
    value = F.when((n < 2) | (F.get(b, n - 1)["le"] != float("inf")) | (total == 0), N.nan()).when(F.lit(q < 0), -N.inf()).when(F.lit(q > 1), N.inf()).when(k >= n - 1, F.get(b, n - 2)["le"]).when((k == 0) & (top <= 0), top).otherwise(inside)
    return rows.select("labels", "step_ms", value.alias("value"))
