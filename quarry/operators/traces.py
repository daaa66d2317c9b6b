"""TraceQL over Spark: spans stay rows; what concerns a trace is a window or a semi join on trace_id.

Spans: trace_id, span_id, parent_span_id (null: root), name, kind, status, status_message, start_ns,
duration_ns, service, attributes, scope_attributes, resource_attributes MAP<STRING, STRING>, events
ARRAY<STRUCT<ts_ns, name, attributes>>, links ARRAY<STRUCT<trace_id, span_id, attributes>>, scope_name,
scope_version. Attribute values are strings; one that reads as a number compares as a number with numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions.labels import java, key
from ..plans import traceql as T
from ..plans.lexer import QueryError
from ..session import cut_lineage
from .grid import Grid

NUMERIC = {"number", "duration"}
TRACE_LEVEL = {"rootName", "rootServiceName", "traceDuration", "childCount", "nestedSetLeft", "nestedSetRight", "nestedSetParent"}


@dataclass(frozen=True)
class Field:
    """A compiled expression: its kind if known (None: an attribute), its text, number and truth."""

    kind: str | None
    text: Column
    number: Column
    truth: Column


def _field(kind: str | None, c: Column) -> Field:
    number = c.cast("double") if kind in NUMERIC else c.try_cast("double") if kind is None else F.lit(None).cast("double")
    truth = c if kind == "bool" else (F.lower(c) == "true") if kind is None else F.lit(False)
    return Field(kind, c.cast("string"), number, F.coalesce(truth, F.lit(False)))


class TraceEngine:
    def __init__(self, spans: DataFrame):
        self.spark: SparkSession = spans.sparkSession
        self.spans = spans

    # expressions

    def compile(self, e) -> Field:
        if isinstance(e, T.Static):
            return _field(e.kind, F.lit(e.value) if e.value is not None else F.lit(None).cast("string"))
        if isinstance(e, T.Intrinsic):
            return self._intrinsic(e.name)
        if isinstance(e, T.Attribute):
            return _field(None, self._attribute(e.scope, e.name))
        a = self.compile(e.left)
        if e.right is None:
            return _field("number", -a.number) if e.op == "-" else _field("bool", ~a.truth)
        b = self.compile(e.right)
        if e.op in ("&&", "||"):
            return _field("bool", a.truth & b.truth if e.op == "&&" else a.truth | b.truth)
        if e.op in ("+", "-", "*", "/", "%", "^"):
            x, y = (F.coalesce(f.number, N.nan()) for f in (a, b))
            made = N.arithmetic(e.op, x, y)
            if e.op in "/%":  # a zero dividend gives NaN
                made = F.when(x == 0, N.nan()).otherwise(made)
            return _field("number", made)
        if e.op in ("=~", "!~"):
            hit = a.text.rlike(java(e.right.value))
            return _field("bool", F.coalesce(hit if e.op == "=~" else ~hit, F.lit(False)))
        return _field("bool", self._compare(e.op, a, b))

    def _compare(self, op: str, a: Field, b: Field) -> Column:
        """Same kinds in natural order, numbers as numbers; other pairs are unequal, and less."""
        apart = F.lit(op in ("!=", "<", "<="))
        ops = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y}
        nil = [f for f in (a, b) if f.kind == "nil"]
        if nil:
            other = (b if a.kind == "nil" else a).text
            return other.isNull() if op == "=" else other.isNotNull()
        if a.kind in NUMERIC or b.kind in NUMERIC:
            number = N.compare("==" if op == "=" else op, a.number, b.number)
            return F.when(a.number.isNotNull() & b.number.isNotNull(), number).otherwise(apart)
        if a.kind is not None and b.kind is not None and a.kind != b.kind:
            return apart
        if "bool" in (a.kind, b.kind):
            known = F.lower(a.text).isin("true", "false") & F.lower(b.text).isin("true", "false")
            return F.when(known, ops[op](a.truth, b.truth)).otherwise(apart)
        return F.when(a.text.isNotNull() & b.text.isNotNull(), ops[op](a.text, b.text)).otherwise(apart)

    def _intrinsic(self, name: str) -> Field:
        c = F.col
        plain = {"name": ("string", c("name")), "statusMessage": ("string", c("status_message")), "status": ("status", c("status")), "kind": ("kind", c("kind")), "duration": ("duration", c("duration_ns")), "span:id": ("string", c("span_id")), "span:parentID": ("string", c("parent_span_id")), "trace:id": ("string", c("trace_id")), "instrumentation:name": ("string", c("scope_name")), "instrumentation:version": ("string", c("scope_version"))}
        if name in plain:
            return _field(*plain[name])
        if name == "parent":
            return _field(None, F.when(c("parent_span_id").isNotNull(), "true"))
        if name in ("rootName", "rootServiceName"):
            return _field("string", c("_root_name" if name == "rootName" else "_root_service"))
        if name == "traceDuration":
            return _field("duration", c("_trace_ns"))
        if name == "childCount":
            return _field("number", c("_children"))
        if name.startswith("nestedSet"):
            return _field("number", c(f"_{name[9:].lower()}"))
        array, pick, kind = {
            "event:name": ("events", lambda x: F.nullif(x["name"], F.lit("")), "string"), "event:timeSinceStart": ("events", lambda x: F.nullif(x["ts_ns"], F.lit(0)) - c("start_ns"), "duration"),
            "link:traceID": ("links", lambda x: F.nullif(x["trace_id"], F.lit("")), "string"), "link:spanID": ("links", lambda x: F.nullif(x["span_id"], F.lit("")), "string"),
        }[name]
        return _field(kind, F.get(F.filter(F.transform(array, pick), lambda x: x.isNotNull()), F.lit(0)))

    def _attribute(self, scope: str, name: str) -> Column:
        own, scoped, res = (F.col(x)[name] for x in ("attributes", "scope_attributes", "resource_attributes"))
        if scope in ("event", "link"):
            return F.get(F.filter(F.transform(f"{scope}s", lambda x: x["attributes"][name]), lambda x: x.isNotNull()), F.lit(0))
        if scope == "parent":
            return F.col("_parent_attributes")[name]
        return {"": F.coalesce(own, scoped, res), "span": own, "resource": F.coalesce(scoped, res), "instrumentation": scoped}[scope]

    def _needs(self, e, out: set | None = None) -> set:
        out = set() if out is None else out
        if isinstance(e, T.Intrinsic) and e.name in TRACE_LEVEL:
            out.add({"childCount": "children"}.get(e.name, "nested" if e.name.startswith("nested") else "trace"))
        if isinstance(e, T.Attribute) and e.scope == "parent":
            out.add("parent")
        if hasattr(e, "__dataclass_fields__"):
            for k in e.__dataclass_fields__:
                self._needs(getattr(e, k), out)
        if isinstance(e, tuple):
            for x in e:
                self._needs(x, out)
        return out

    def _with(self, df: DataFrame, needs: set) -> DataFrame:
        """Trace-level columns, only where a query names them."""
        w = Window.partitionBy("trace_id")
        if "trace" in needs and "_trace_ns" not in df.columns:
            root = F.when(F.col("parent_span_id").isNull(), F.struct("start_ns", "name", "service"))
            df = df.withColumn("_r", F.min(root).over(w)).withColumns({"_root_name": F.col("_r.name"), "_root_service": F.col("_r.service"), "_trace_ns": F.max(F.col("start_ns") + F.col("duration_ns")).over(w) - F.min("start_ns").over(w)}).drop("_r")
        if "children" in needs and "_children" not in df.columns:
            n = self.spans.where("parent_span_id is not null").groupBy("trace_id", F.col("parent_span_id").alias("span_id")).agg(F.count("*").alias("_children"))
            df = df.join(n, ["trace_id", "span_id"], "left").fillna(0, ["_children"])
        if "nested" in needs and "_left" not in df.columns:
            df = df.join(nested_sets(self.spans), ["trace_id", "span_id"], "left")
        if "parent" in needs and "_parent_attributes" not in df.columns:
            parents = self.spans.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("attributes").alias("_parent_attributes"))
            df = df.join(parents, ["trace_id", "parent_span_id"], "left").select(*df.columns, "_parent_attributes")
        return df

    # spansets

    def select(self, query: str, start_ns: int | None = None, end_ns: int | None = None, min_ns: int | None = None, max_ns: int | None = None) -> DataFrame:
        """The spans a query selects."""
        tree = T.parse(query)
        out = self._eval(tree, self._needs(tree))
        if any(x is not None for x in (start_ns, end_ns, min_ns, max_ns)):
            w = self.spans.groupBy("trace_id").agg(F.min("start_ns").alias("s"), F.max(F.col("start_ns") + F.col("duration_ns")).alias("e"))
            cond = F.lit(True)
            for bound, test in ((start_ns, F.col("s") >= start_ns), (end_ns, F.col("e") <= end_ns), (min_ns, F.col("e") - F.col("s") >= min_ns), (max_ns, F.col("e") - F.col("s") <= max_ns)):
                cond = cond & test if bound is not None else cond
            out = out.join(w.where(cond).select("trace_id"), "trace_id", "left_semi")
        return out

    def search(self, query: str, limit: int = 20, **bounds) -> DataFrame:
        """A row for each trace, by start, with its matched spans."""
        spans = self.select(query, **bounds)
        per = spans.groupBy("trace_id").agg(F.min("start_ns").alias("first_ns"), F.count("*").alias("matched"))
        traces = self.spans.join(per.select("trace_id"), "trace_id", "left_semi").groupBy("trace_id").agg(F.min("start_ns").alias("start_ns"), (F.max(F.col("start_ns") + F.col("duration_ns")) - F.min("start_ns")).alias("duration_ns"), F.min(F.when(F.col("parent_span_id").isNull(), F.struct("start_ns", "name", "service"))).alias("r"))
        return traces.join(per, "trace_id").orderBy("start_ns", "trace_id").limit(limit).select("trace_id", "start_ns", "duration_ns", F.col("r.name").alias("root_name"), F.col("r.service").alias("root_service"), "matched")

    def search_spans(self, query: str, **bounds) -> DataFrame:
        """The matched spans with those attributes only that the query names, of all scopes in one map."""
        tree = T.parse(query)
        names = sorted(set(_attribute_names(tree)))
        every = F.map_concat(*(F.map_filter(m, (lambda later: lambda k, v: k.isin(names) & ~_in_any(k, later))(later)) for m, later in (("resource_attributes", ("scope_attributes", "attributes")), ("scope_attributes", ("attributes",)), ("attributes", ())))) if names else F.create_map().cast("map<string,string>")
        return self.select(query, **bounds).select("trace_id", "span_id", "start_ns", "duration_ns", every.alias("attributes"))

    def by_id(self, trace_id: str) -> DataFrame:
        return self.spans.where(F.col("trace_id") == trace_id.lower().rjust(32, "0"))

    def search_tags(self, tags: dict[str, str], min_ns: int | None = None, max_ns: int | None = None) -> DataFrame:
        """Whole traces that have a span with all the tags, within the duration of the span."""
        cond = F.lit(True)
        for k, v in tags.items():
            cond &= F.col("name") == v if k == "name" else F.greatest(*(F.coalesce((F.col(m)[k] == v).cast("int"), F.lit(0)) for m in ("attributes", "resource_attributes", "scope_attributes"))) == 1
        if min_ns is not None:
            cond &= F.col("duration_ns") >= min_ns
        if max_ns is not None:
            cond &= F.col("duration_ns") <= max_ns
        return self.spans.join(self.spans.where(cond).select("trace_id").distinct(), "trace_id", "left_semi")

    def _eval(self, e, needs: set) -> DataFrame:
        if isinstance(e, T.Filter):
            return self._with(self.spans, needs).where(self.compile(e.expr).truth)
        if isinstance(e, T.Spansets):
            return self._structural(e, self._eval(e.left, needs), self._eval(e.right, needs))
        df = self._eval(e.spans, needs)
        group = ["trace_id"]
        for stage in e.stages:
            if stage[0] == "filter":
                df = df.where(self.compile(stage[1]).truth)
            elif stage[0] == "scalar":
                w = Window.partitionBy(*group)
                df = df.withColumns({"_x": self._scalar(stage[2], w), "_y": self._scalar(stage[3], w)})
                df = df.where(N.compare("==" if stage[1] == "=" else stage[1], F.col("_x"), F.col("_y"))).drop("_x", "_y")
            elif stage[0] == "by":
                df = df.withColumn("_by", F.concat_ws("\0", *(F.coalesce(self.compile(f).text, F.lit("nil")) for f in stage[1])))
                group = ["trace_id", "_by"]
            elif stage[0] == "coalesce":
                group = ["trace_id"]
            elif stage[0] == "select":
                df = df.withColumn("selected", F.array(*(self.compile(f).text for f in stage[1])))
            else:
                raise QueryError("a metrics stage needs metrics()")
        return df

    def _scalar(self, e, w) -> Column:
        if isinstance(e, T.Static):
            return F.lit(float(e.value))
        if isinstance(e, T.Op):
            return N.arithmetic(e.op, self._scalar(e.left, w), self._scalar(e.right, w))
        n = F.count("*").over(w).cast("double")
        if e.op == "count":
            return n
        v = self.compile(e.field).number
        zero = F.lit(0.0)
        total = F.coalesce(F.sum(v).over(w), zero)
        return {"sum": total, "avg": total / n, "max": F.coalesce(F.max(v).over(w), zero), "min": F.coalesce(F.min(v).over(w), zero)}[e.op]

    def _structural(self, e: T.Spansets, a: DataFrame, b: DataFrame) -> DataFrame:
        ids = ["trace_id", "span_id"]
        if e.op in ("||", "&&"):
            both = a.unionByName(b, allowMissingColumns=True).dropDuplicates(ids)
            if e.op == "||":
                return both
            there = a.select("trace_id").distinct().join(b.select("trace_id").distinct(), "trace_id", "left_semi")
            return both.join(there, "trace_id", "left_semi")
        op = e.op.lstrip("!&")
        met, meets = (self._lines if op in (">>", "<<") else self._neighbours)(op, a, b)
        right = b.join(met, ids, "left_anti" if e.op[0] == "!" else "left_semi")
        if e.op[0] != "&":
            return right
        left = a.join(meets, ids, "left_semi")
        return left.unionByName(right, allowMissingColumns=True).dropDuplicates(ids)

    def _neighbours(self, op: str, a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(trace_id, span_id) of the spans of b, and of a, that have one of the other side next to them."""
        left = a.select("trace_id", F.col("span_id").alias("l"), F.coalesce("parent_span_id", F.lit("")).alias("lp"))
        right = b.select("trace_id", F.col("span_id").alias("r"), F.coalesce("parent_span_id", F.lit("")).alias("rp"))
        on = {">": right["rp"] == left["l"], "<": left["lp"] == right["r"], "~": left["lp"] == right["rp"]}[op]
        pairs = left.join(right, (left["trace_id"] == right["trace_id"]) & on).select(left["trace_id"], "l", "r")
        met, meets = (pairs.select("trace_id", F.col(k).alias("span_id")).distinct() for k in "rl")
        return met, meets

    def _lines(self, op: str, a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(trace_id, span_id) of the spans of b, and of a, that have one of the other side above or below them.

        Lines of descent pass through spans of either side only. A span stays one row: each round doubles how
        far up its pointer reaches and takes over whether a span of the upper side was passed (up), and tells
        the pointer's span whether one of the lower side was (down), until all lines are at their top or as long as
        the largest trace. A round is written, so plans stay small. Spans in a cycle of parents are above and below each other.
        """
        ids = ["trace_id", "span_id"]
        upper, lower = (a, b) if op == ">>" else (b, a)
        sides = [df.select(*ids, "parent_span_id", F.lit(k == 0).alias("top"), F.lit(k == 1).alias("low")) for k, df in enumerate((upper, lower))]
        spans = sides[0].unionByName(sides[1]).groupBy(*ids).agg(F.min("parent_span_id").alias("ptr"), F.max("top").alias("top"), F.max("low").alias("low"))
        spans = cut_lineage(spans.withColumn("ptr", F.when(F.col("ptr") != F.col("span_id"), F.col("ptr"))))
        none = F.lit(False)
        now = spans.withColumns({"up": none, "down": none})
        longest = spans.groupBy("trace_id").count().agg(F.max("count")).first()[0] or 0
        for turn in range(longest.bit_length() + 1):
            above = now.select("trace_id", F.col("span_id").alias("ptr"), F.col("ptr" if turn else "span_id").alias("next"), F.col("up" if turn else "top").alias("passed"))
            below = now.where("ptr is not null").groupBy("trace_id", F.col("ptr").alias("span_id")).agg(F.max("down" if turn else "low").alias("told"))
            step = now.join(above, ["trace_id", "ptr"], "left").join(below, ids, "left")
            up, down = (F.col(x) | F.coalesce(y, none) for x, y in (("up", "passed"), ("down", "told")))
            now = cut_lineage(step.select(*ids, F.col("next").alias("ptr"), "top", "low", up.alias("up"), down.alias("down")))
            if not now.where("ptr is not null").limit(1).count():
                break
        under, over = now.where("low and up").select(*ids), now.where("top and down").select(*ids)
        return (under, over) if op == ">>" else (over, under)

    # beyond spans

    def metrics(self, query: str, start_ms: int, end_ms: int, step_ms: int) -> DataFrame:
        """(labels, step_ms, value) of a query with a metrics stage; each step counts the spans that start in it.

        What follows the stage picks series: a comparison with a number, topk and bottomk of each step.
        """
        return self._metrics(T.parse(query), start_ms, end_ms, step_ms)

    def _metrics(self, tree, start_ms: int, end_ms: int, step_ms: int) -> DataFrame:
        if isinstance(tree, T.Math):
            return self._math(tree, *(x if isinstance(x, float) else self._metrics(x, start_ms, end_ms, step_ms) for x in (tree.left, tree.right)))
        at = next((k for k, s in enumerate(tree.stages) if s[0] == "metric"), None) if isinstance(tree, T.Pipeline) else None
        if at is None:
            raise QueryError("not a metrics query")
        _, name, args, by = tree.stages[at]
        needs = self._needs(tree)
        df = self._eval(T.Pipeline(tree.spans, tree.stages[:at]) if at else tree.spans, needs)
        labels = [x for k, f in enumerate(by) for x in (F.lit(getattr(f, "name", str(k))), F.coalesce(self.compile(f).text, F.lit("nil")))]
        value = self.compile(args[0]).number if args else F.lit(1.0)
        rows = df.select((F.create_map(*labels) if labels else F.create_map().cast("map<string,string>")).alias("labels"), N.ceil_div(F.col("start_ns"), 10**6).alias("ts_ms"), value.alias("value"))
        v = F.col("value")
        made = {"rate": F.count("*") / (step_ms / 1000.0), "count_over_time": F.count("*").cast("double"), "min_over_time": F.min(v), "max_over_time": F.max(v), "sum_over_time": F.sum(v), "avg_over_time": F.avg(v)}.get(name)
        if name == "quantile_over_time":
            made = N.quantile(float(args[1].value), v)
        out = Grid(start_ms, end_ms, step_ms).fan_out(rows, step_ms).groupBy("labels", "step_ms").agg(made.alias("value"))
        for stage in tree.stages[at + 1 :]:
            if stage[0] == "scalar-math":
                out = out.withColumn("value", N.arithmetic(stage[1], v, F.lit(stage[2])))
            elif stage[0] == "compare":
                out = out.where(N.compare("==" if stage[1] == "=" else stage[1], v, F.lit(stage[2])))
            elif stage[0] == "top":
                w = Window.partitionBy("step_ms").orderBy(F.isnan(v), v.desc() if stage[1] == "topk" else v.asc(), key(F.col("labels")))
                out = out.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= stage[2]).drop("nth")
            else:
                raise QueryError("only comparisons, topk and bottomk follow a metrics stage")
        return out

    def _math(self, e: T.Math, a: DataFrame | float, b: DataFrame | float) -> DataFrame:
        """Series with equal labels meet at each step; a number meets all."""
        if isinstance(a, float) or isinstance(b, float):
            df, v = (b, F.col("value")) if isinstance(a, float) else (a, F.col("value"))
            x, y = (F.lit(a), v) if isinstance(a, float) else (v, F.lit(b))
            return df.withColumn("value", N.arithmetic(e.op, x, y))
        a, b = (df.withColumn("k", key(F.col("labels"))) for df in (a, b))
        both = a.join(b.select("k", "step_ms", F.col("value").alias("o")), ["k", "step_ms"])
        return both.select("labels", "step_ms", N.arithmetic(e.op, F.col("value"), F.col("o")).alias("value"))

    def compare(self, query: str) -> DataFrame:
        """(grp, attribute, value, n): the commonest values of each attribute among the spans that a filter selects, and among the rest.

        Attributes have their scope before their name; name and kind are attributes too. The window, if there is one, bounds the selection.
        """
        tree = T.parse(query)
        if not isinstance(tree, T.Pipeline) or tree.stages[-1][0] != "compare-groups":
            raise QueryError("not a comparison")
        _, test, top, start, end = tree.stages[-1]
        df = self._eval(T.Pipeline(tree.spans, tree.stages[:-1]) if tree.stages[:-1] else tree.spans, self._needs(tree))
        chosen = self.compile(test).truth
        if end:
            chosen &= (F.col("start_ns") >= start) & (F.col("start_ns") < end)
        scopes = (("span", "attributes"), ("resource", "resource_attributes"), ("instrumentation", "scope_attributes"))
        found = [F.transform(F.map_entries(c), (lambda s: lambda e: F.struct(F.concat(F.lit(f"{s}."), e["key"]).alias("attribute"), e["value"].alias("value")))(s)) for s, c in scopes]
        own = F.array(*(F.struct(F.lit(x).alias("attribute"), F.col(x).alias("value")) for x in ("name", "kind")))
        rows = df.select(F.when(chosen, "selection").otherwise("baseline").alias("grp"), F.explode(F.concat(own, *found)).alias("x"))
        per = rows.groupBy("grp", "x.attribute", "x.value").agg(F.count("*").alias("n"))
        w = Window.partitionBy("grp", "attribute").orderBy(F.col("n").desc(), "value")
        return per.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= top).drop("nth")

    def tag_names(self) -> DataFrame:
        scopes = {"span": F.map_keys("attributes"), "resource": F.map_keys("resource_attributes"), "instrumentation": F.map_keys("scope_attributes")}
        scopes |= {x: F.flatten(F.transform(f"{x}s", lambda e: F.map_keys(e["attributes"]))) for x in ("event", "link")}
        tags = F.flatten(F.array(*(F.transform(c, (lambda s: lambda t: F.struct(F.lit(s).alias("scope"), t.alias("tag")))(s)) for s, c in scopes.items())))
        return self.spans.select(F.explode(tags).alias("x")).select("x.scope", "x.tag").distinct()

    def tag_values(self, tag: str, query: str | None = None) -> DataFrame:
        df = self.select(query) if query else self.spans
        value = self._intrinsic(tag).text if tag in T.INTRINSICS - TRACE_LEVEL else self._attribute("", tag.lstrip("."))
        return df.select(value.alias("value")).where("value is not null").distinct()


def _attribute_names(e) -> list[str]:
    """Names of all attributes in a tree."""
    if isinstance(e, T.Attribute):
        return [e.name]
    parts = e if isinstance(e, tuple) else [getattr(e, k) for k in getattr(e, "__dataclass_fields__", ())]
    return [n for p in parts for n in _attribute_names(p)]


def _in_any(k: Column, maps: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in maps:
        out |= F.map_contains_key(m, k)
    return out


def nested_sets(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id, _left, _right, _parent): a numbering of each trace in which a span's numbers enclose those below it.

    Spans without a parent in their trace begin trees, in the order of start and id, as children do; _parent is the
    parent's left number, -1 without one. What hangs on a ring of parents has none. Ids of one trace meet in a task.
    """
    import pyarrow as pa

    def number(trace: pa.Table) -> pa.Table:
        rows = sorted({(s, i, p) for i, p, s in zip(*(trace.column(c).to_pylist() for c in ("span_id", "parent_span_id", "start_ns")), strict=True)}, key=lambda r: (r[0], r[1], r[2] or ""))
        parents = dict((i, p) for _, i, p in reversed(rows))
        ids = list(dict.fromkeys(i for _, i, _ in rows))
        there, below = set(ids), {}
        for i in ids:
            below.setdefault(parents[i] if parents[i] in there else None, []).append(i)
        left, right, above, n = {}, {}, {}, 0
        todo = [(i, -1, False) for i in reversed(below.get(None, []))]
        while todo:
            i, p, done = todo.pop()
            n += 1
            if done:
                right[i] = n
                continue
            left[i], above[i] = n, p
            todo.append((i, p, True))
            todo += [(k, n, False) for k in reversed(below.get(i, []))]
        some = list(left)
        numbers = (pa.array([x[i] for i in some], pa.int64()) for x in (left, right, above))
        return pa.Table.from_arrays([pa.array([trace.column("trace_id")[0].as_py()] * len(some), pa.string()), pa.array(some, pa.string()), *numbers], ["trace_id", "span_id", "_left", "_right", "_parent"])

    return spans.select("trace_id", "span_id", "parent_span_id", "start_ns").groupBy("trace_id").applyInArrow(number, "trace_id string, span_id string, _left long, _right long, _parent long")
