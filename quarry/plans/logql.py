"""LogQL: text to a typed tree."""

from __future__ import annotations

from dataclasses import dataclass, replace

from ..functions.numbers import byte_size, duration_ns
from .lexer import Cursor, QueryError, matchers, name_list

RANGE = {"count_over_time", "rate", "rate_counter", "bytes_over_time", "bytes_rate", "avg_over_time", "sum_over_time", "min_over_time", "max_over_time", "stddev_over_time", "stdvar_over_time", "quantile_over_time", "first_over_time", "last_over_time", "absent_over_time"}
NEEDS_UNWRAP = {"rate_counter", "avg_over_time", "sum_over_time", "min_over_time", "max_over_time", "stddev_over_time", "stdvar_over_time", "quantile_over_time", "first_over_time", "last_over_time"}
VECTOR = {"sum", "avg", "count", "max", "min", "stddev", "stdvar", "topk", "bottomk", "sort", "sort_desc"}
LEVELS = [{"or"}, {"and", "unless"}, {"==", "!=", ">", "<", ">=", "<="}, {"+", "-"}, {"*", "/", "%"}, {"^"}]


@dataclass(frozen=True)
class Logs:
    matchers: tuple
    stages: tuple = ()


@dataclass(frozen=True)
class RangeAgg:
    op: str
    logs: Logs
    range_ms: int
    offset_ms: int = 0
    parameter: float | None = None
    by: tuple | None = None
    without: tuple | None = None


@dataclass(frozen=True)
class VectorAgg:
    op: str
    expr: object
    k: int | None = None
    by: tuple | None = None
    without: tuple | None = None


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object
    bool_: bool = False


@dataclass(frozen=True)
class Literal:
    value: float


@dataclass(frozen=True)
class Replace:
    expr: object
    args: tuple


@dataclass(frozen=True)
class Vector:
    value: float


@dataclass(frozen=True)
class Test:
    """A label filter: kind is string, number, duration, bytes or ip."""

    label: str
    op: str
    kind: str
    value: object


@dataclass(frozen=True)
class Both:
    op: str
    left: object
    right: object


def parse(query: str):
    c = Cursor(query)
    if c.is_("{") or c.is_("(") and _logs_ahead(c):
        out = _logs(c)
    else:
        out = _metric(c, 0)
    c.end()
    return out


def _logs_ahead(c: Cursor) -> bool:
    n = 0
    while c.ahead(n).text == "(":
        n += 1
    return c.ahead(n).text == "{"


def _logs(c: Cursor) -> Logs:
    if c.accept("("):
        out = _logs(c)
        c.expect(")")
    else:
        c.expect("{")
        out = Logs(tuple(matchers(c)))
    return replace(out, stages=out.stages + tuple(_stages(c)))


def _stages(c: Cursor) -> list:
    out = []
    while c.is_("|", "|=", "|~", "!=", "!~", "|>", "!>"):
        if not c.is_("|"):
            out.append(_line_filter(c))
            continue
        c.take()
        out.append(_stage(c))
    return out


def _line_filter(c: Cursor):
    op, items = c.take().text, []
    while True:
        if c.accept("ip"):
            c.expect("(")
            items.append(("ip", c.string()))
            c.expect(")")
        else:
            items.append(("text", c.string()))
        if not c.accept("or"):
            return ("line", op, tuple(items))


def _stage(c: Cursor):
    if c.now.kind == "name" and not _is_test(c):
        name = c.take().text
        if name in ("json", "logfmt"):
            while c.is_("-"):  # flags are read and make no difference
                while c.accept("-"):
                    pass
                c.kind("name")
                while c.accept("-"):
                    c.kind("name")
            return (name, tuple(_extracts(c)))
        if name in ("regexp", "pattern", "line_format"):
            return (name, c.string())
        if name in ("unpack", "decolorize"):
            return (name,)
        if name == "label_format":
            out = []
            while True:
                target = _label(c)
                c.expect("=")
                out.append((target, "template", c.string()) if c.now.kind == "string" else (target, "rename", _label(c)))
                if not c.accept(","):
                    return (name, tuple(out))
        if name in ("drop", "keep", "distinct"):
            out = []
            while True:
                label = _label(c)
                out.append((label, c.take().text, c.string()) if c.is_("=", "!=", "=~", "!~") else (label, None, None))
                if not c.accept(","):
                    return (name, tuple(out))
        if name == "unwrap":
            label = _label(c)
            if c.accept("("):
                inner = _label(c)
                c.expect(")")
                return (name, inner, label)
            return (name, label, None)
        raise QueryError(f"unknown stage {name}")
    return ("filter", _tests(c))


def _is_test(c: Cursor) -> bool:
    n = 1
    while c.ahead(n).text == ".":
        n += 2
    return c.ahead(n).text in ("=", "!=", "=~", "!~", "==", ">", "<", ">=", "<=") and c.now.text not in ("label_format",)


def _label(c: Cursor) -> str:
    name = c.kind("name")
    while c.accept("."):
        name += "." + c.kind("name")
    return name


def _extracts(c: Cursor) -> list:
    out = []
    while c.now.kind == "name":
        label = _label(c)
        out.append((label, c.string()) if c.accept("=") else (label, label))
        if not c.accept(","):
            break
    return out


def _tests(c: Cursor):
    left = _ands(c)
    while c.accept("or"):
        left = Both("or", left, _ands(c))
    return left


def _ands(c: Cursor):
    left = _test(c)
    while c.is_("and", ",") or c.now.kind == "name" and c.now.text != "or" and _is_test(c):
        if c.is_("and", ","):
            c.take()
        left = Both("and", left, _test(c))
    return left


def _test(c: Cursor):
    if c.accept("("):
        out = _tests(c)
        c.expect(")")
        return out
    label, op = _label(c), c.expect("=", "!=", "=~", "!~", "==", ">", "<", ">=", "<=")
    minus = bool(c.accept("-"))
    t = c.now
    if t.kind == "string":
        return Test(label, op, "string", c.string())
    if c.accept("ip"):
        c.expect("(")
        out = Test(label, op, "ip", c.string())
        c.expect(")")
        return out
    c.take()
    value = {"number": float, "duration": lambda x: duration_ns(x) / 1e9, "bytes": byte_size}[t.kind](t.text)
    return Test(label, op, t.kind, -value if minus else value)


def _grouping(c: Cursor) -> dict[str, tuple]:
    return {c.take().text: tuple(name_list(c))} if c.is_("by", "without") else {}


def _metric(c: Cursor, level: int):
    if level == len(LEVELS):
        return _primary(c)
    left = _metric(c, level + 1)
    while c.is_(*LEVELS[level]):
        op = c.take().text
        bool_ = bool(c.accept("bool"))
        if c.is_("on", "ignoring", "group_left", "group_right"):
            raise QueryError("vector matching modifiers are not supported")
        left = Binary(op, left, _metric(c, level if op == "^" else level + 1), bool_)
    return left


def _number(c: Cursor) -> float:
    sign = -1.0 if c.accept("-") else 1.0
    c.accept("+")
    return sign * float(c.kind("number"))


def _primary(c: Cursor):
    if c.now.kind == "number" or c.is_("-", "+"):
        return Literal(_number(c))
    if c.accept("("):
        out = _metric(c, 0)
        c.expect(")")
        return out
    op = c.kind("name")
    if op == "vector":
        c.expect("(")
        out = Vector(_number(c))
        c.expect(")")
        return out
    if op == "label_replace":
        c.expect("(")
        inner, args = _metric(c, 0), []
        while c.accept(","):
            args.append(c.string())
        c.expect(")")
        return Replace(inner, tuple(args))
    if op in RANGE:
        return _range(c, op)
    if op not in VECTOR:
        raise QueryError(f"unknown function {op}")
    how = _grouping(c)
    c.expect("(")
    k = None
    if op in ("topk", "bottomk"):
        k = int(_number(c))
        if k < 1:
            raise QueryError("k must be positive")
        c.expect(",")
    inner = _metric(c, 0)
    c.expect(")")
    return VectorAgg(op, inner, k, **(how or _grouping(c)))


def _range(c: Cursor, op: str) -> RangeAgg:
    c.expect("(")
    parameter = None
    if op == "quantile_over_time":
        parameter = _number(c)
        c.expect(",")
    depth = 0
    while c.accept("("):
        depth += 1
    logs, size, offset = _logs(c), None, 0
    while True:
        if c.accept("["):
            size = duration_ns(c.kind("duration")) // 10**6
            c.expect("]")
        elif c.accept("offset"):
            minus = bool(c.accept("-"))
            offset = duration_ns(c.kind("duration")) // 10**6 * (-1 if minus else 1)
        elif c.is_("|", "|=", "|~", "!=", "!~", "|>", "!>"):
            logs = replace(logs, stages=logs.stages + tuple(_stages(c)))
        elif depth and c.accept(")"):
            depth -= 1
        else:
            break
    if size is None:
        raise QueryError("a range is missing")
    c.expect(")")
    unwraps = any(s[0] == "unwrap" for s in logs.stages)
    if op in NEEDS_UNWRAP and not unwraps:
        raise QueryError(f"{op} needs unwrap")
    return RangeAgg(op, logs, size, offset, parameter, **_grouping(c))
