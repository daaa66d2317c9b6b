"""TraceQL: text to a typed tree."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.numbers import duration_ns
from .lexer import Cursor, QueryError

FIELD_LEVELS = [{"||"}, {"&&"}, {"=", "!=", "=~", "!~", ">", ">=", "<", "<="}, {"+", "-"}, {"*", "/", "%"}, {"^"}]
#: Spanset operators, loosest first.
SPANSET_LEVELS = [{"||"}, {"&&"}, {">", ">>", "<", "<<", "~", "!>", "!<", "!>>", "!<<", "!~", "&>", "&<", "&>>", "&<<", "&~"}]
INTRINSICS = {"duration", "name", "status", "statusMessage", "kind", "parent", "rootName", "rootServiceName", "traceDuration", "childCount", "nestedSetLeft", "nestedSetRight", "nestedSetParent"}
SCOPED = {"span:id", "span:parentID", "trace:id", "event:name", "event:timeSinceStart", "link:traceID", "link:spanID", "instrumentation:name", "instrumentation:version", "span:duration", "span:name", "span:status", "span:kind", "span:statusMessage", "trace:duration", "trace:rootName", "trace:rootService"}
AGGREGATES = {"count", "max", "min", "avg", "sum"}
METRICS = {"rate", "count_over_time", "min_over_time", "max_over_time", "sum_over_time", "avg_over_time", "quantile_over_time"}


@dataclass(frozen=True)
class Static:
    kind: str  # string number duration bool status kind nil
    value: object


@dataclass(frozen=True)
class Attribute:
    scope: str
    name: str


@dataclass(frozen=True)
class Intrinsic:
    name: str


@dataclass(frozen=True)
class Op:
    op: str
    left: object
    right: object = None


@dataclass(frozen=True)
class Filter:
    expr: object


@dataclass(frozen=True)
class Spansets:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Pipeline:
    spans: object
    stages: tuple


NUMERIC_INTRINSICS = {"duration", "traceDuration", "childCount", "event:timeSinceStart", "nestedSetLeft", "nestedSetRight", "nestedSetParent"}
COMPARISONS = ("=", "!=", ">", ">=", "<", "<=")
#: Stages that may stand before topk and bottomk.
AFTER_METRICS = {"metric", "compare", "top", "scalar-math"}


@dataclass(frozen=True)
class Scalar:
    """An aggregate over a trace's spans."""

    op: str
    field: object = None


@dataclass(frozen=True)
class Math:
    """Arithmetic between two metrics queries, or one and a number."""

    op: str
    left: object
    right: object


def parse(query: str):
    c = Cursor(query)
    out = _sums(c, 0)
    c.end()
    return out


def _sums(c: Cursor, level: int):
    """Metrics arithmetic, loosest first; what stands alone is a query of any kind."""
    if level == 2:
        minus = c.is_("-")
        return _number(c) if minus or c.now.kind in ("number", "duration") else _spansets(c, 0)
    left = _sums(c, level + 1)
    while c.is_(*(("+", "-"), ("*", "/"))[level]):
        op, right = c.take().text, _sums(c, level + 1)
        sides = (left, right)
        if all(isinstance(x, float) for x in sides) or not all(isinstance(x, float | Math) or isinstance(x, Pipeline) and any(s[0] == "metric" for s in x.stages) for x in sides):
            raise QueryError("arithmetic is between metrics queries, or one and a number")
        left = Math(op, left, right)
    return left


def _kind(e) -> str | None:
    """What is known of a field's type; None for attributes."""
    if isinstance(e, Static):
        return "number" if e.kind == "duration" else e.kind
    if isinstance(e, Intrinsic):
        return {"status": "status", "kind": "kind", "parent": None}.get(e.name, "number" if e.name in NUMERIC_INTRINSICS else "string")
    if isinstance(e, Op):
        return "number" if e.op in ("+", "-", "*", "/", "%", "^") else "bool"
    return None


def _checked(op: str, left, right=None) -> Op:
    """The operator, if it is defined on what is known of its operands."""
    kinds = [_kind(left)] + ([_kind(right)] if right is not None else [])
    if right is None:
        defined = {"-": {"number"}, "!": {"bool"}}[op]
    elif op in ("&&", "||"):
        defined = {"bool"}
    elif op in ("=~", "!~"):
        defined = {"string"}
    elif op in ("=", "!="):
        defined = {"string", "number", "bool", "nil", "status", "kind"}
    else:
        defined = {"string", "number"} if op in COMPARISONS else {"number"}
    nil = op in ("=", "!=") and "nil" in kinds
    known = {k for k in kinds if k is not None}
    if not nil and (not known <= defined or len(known) > 1):
        raise QueryError(f"{op} is not defined on {' and '.join(k or 'attribute' for k in kinds)}")
    return Op(op, left, right)


def _spansets(c: Cursor, level: int):
    if level == len(SPANSET_LEVELS):
        return _spanset(c)
    left = _spansets(c, level + 1)
    while c.is_(*SPANSET_LEVELS[level]):
        left = Spansets(c.take().text, left, _spansets(c, level + 1))
    return left if level else _piped(c, left)


def _piped(c: Cursor, spans):
    stages = []
    while c.accept("|"):
        if c.is_("{"):
            stages.append(("filter", _spanset(c).expr))
        elif c.is_("by", "select"):
            name = c.take().text
            c.expect("(")
            fields = [_field(c, 0)]
            while c.accept(","):
                fields.append(_field(c, 0))
            c.expect(")")
            stages.append((name, tuple(fields)))
        elif c.accept("coalesce"):
            c.expect("(")
            c.expect(")")
            stages.append(("coalesce",))
        elif c.accept("compare"):
            stages.append(_compare(c))
        elif c.is_(*METRICS):
            name, args = c.take().text, []
            c.expect("(")
            while not c.accept(")"):
                args.append(_field(c, 0))
                c.accept(",")
            by: list = []
            if c.accept("by"):
                c.expect("(")
                while not c.accept(")"):
                    by.append(_field(c, 0))
                    c.accept(",")
            stages.append(("metric", name, tuple(args), tuple(by)))
            while c.is_(*COMPARISONS, "+", "-", "*", "/") and not (c.is_("+", "-", "*", "/") and c.ahead().kind not in ("number", "duration")):
                op = c.take().text
                stages.append(("compare" if op in COMPARISONS else "scalar-math", op, _number(c)))
        elif stages and stages[-1][0] in AFTER_METRICS and c.is_("topk", "bottomk"):
            op = c.take().text
            c.expect("(")
            k = _number(c)
            if k < 1 or k != int(k):
                raise QueryError(f"{op} takes a whole number above 0")
            c.expect(")")
            stages.append(("top", op, int(k)))
        else:
            left = _scalars(c, 3)
            op = c.expect(*COMPARISONS)
            stages.append(("scalar", op, left, _scalars(c, 3)))
    return Pipeline(spans, tuple(stages)) if stages else spans


def _compare(c: Cursor) -> tuple:
    """compare({ ... }[, values of an attribute[, start, end in nanoseconds]])"""
    c.expect("(")
    c.is_("{") or c.expect("{")
    test, numbers = _spanset(c).expr, []
    while c.accept(","):
        numbers.append(_number(c))
    c.expect(")")
    top, start, end = [*numbers, 10, 0, 0][:1] + (numbers[1:] or [0, 0]) if len(numbers) in (0, 1, 3) else (0, 0, 0)
    if not 1 <= top <= 1000 or top != int(top) or len(numbers) == 3 and not 0 < start < end:
        raise QueryError("compare takes a filter, then 1 to 1000 values, then a start before an end")
    return ("compare-groups", test, int(top), int(start), int(end))


def _number(c: Cursor) -> float:
    minus = bool(c.accept("-"))
    if c.now.kind not in ("number", "duration"):
        raise QueryError("a number is needed here")
    value = _atom(c).value
    return -value if minus else value


def _scalars(c: Cursor, level: int):
    if level == len(FIELD_LEVELS):
        if c.accept("("):
            out = _scalars(c, 3)
            c.expect(")")
            return out
        if c.is_(*AGGREGATES):
            op = c.take().text
            c.expect("(")
            field = None if c.is_(")") else _field(c, 0)
            c.expect(")")
            return Scalar(op, field)
        return _atom(c)
    left = _scalars(c, level + 1)
    while c.is_(*FIELD_LEVELS[level]):
        left = Op(c.take().text, left, _scalars(c, level + 1))
    return left


def _spanset(c: Cursor):
    if c.accept("("):
        out = _spansets(c, 0)
        c.expect(")")
        return out
    c.expect("{")
    expr = Static("bool", True) if c.is_("}") else _field(c, 0)
    c.expect("}")
    return Filter(expr)


def _field(c: Cursor, level: int):
    if level == len(FIELD_LEVELS):
        return _atom(c)
    left = _field(c, level + 1)
    while c.is_(*FIELD_LEVELS[level]):
        left = _checked(c.take().text, left, _field(c, level if c.query[c.tokens[c.k - 1].at] == "^" else level + 1))
    return left


def _path(c: Cursor) -> str:
    name = c.string() if c.now.kind == "string" else c.take().text
    while c.is_(".") or c.is_("-") and c.ahead(0).at == c.tokens[c.k - 1].at + len(c.tokens[c.k - 1].text):
        name += c.take().text + c.take().text
    return name


def _atom(c: Cursor):
    if c.accept("("):
        out = _field(c, 0)
        c.expect(")")
        return out
    if c.is_("-", "!"):
        return _checked(c.take().text, _atom(c))
    t = c.now
    if t.kind == "string":
        return Static("string", c.string())
    if t.kind == "number":
        c.take()
        return Static("number", float(t.text))
    if t.kind == "duration":
        c.take()
        return Static("duration", float(duration_ns(t.text)))
    if c.accept("."):
        return Attribute("", _path(c))
    name = c.kind("name")
    if name in SCOPED:
        return Intrinsic({"span:duration": "duration", "span:name": "name", "span:status": "status", "span:kind": "kind", "span:statusMessage": "statusMessage", "trace:duration": "traceDuration", "trace:rootName": "rootName", "trace:rootService": "rootServiceName"}.get(name, name))
    if name in ("span", "resource", "instrumentation", "event", "link", "parent") and c.is_("."):
        c.take()
        return Attribute(name, _path(c))
    if name in ("true", "false"):
        return Static("bool", name == "true")
    if name == "nil":
        return Static("nil", None)
    if name in ("ok", "error", "unset"):
        return Static("status", name)
    if name in ("client", "server", "producer", "consumer", "internal", "unspecified"):
        return Static("kind", name)
    if name in INTRINSICS:
        return Intrinsic(name)
    raise QueryError(f"unknown field {name}")
