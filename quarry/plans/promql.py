"""PromQL: text to a typed tree."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from ..functions.numbers import duration_ns
from .lexer import Cursor, QueryError, matchers, name_list

AGGREGATES = {"sum", "avg", "min", "max", "count", "group", "stddev", "stdvar", "topk", "bottomk", "limitk", "limit_ratio", "quantile", "count_values"}
WITH_PARAMETER = {"topk", "bottomk", "limitk", "limit_ratio", "quantile", "count_values"}
#: Loosest first.
LEVELS = [{"or"}, {"and", "unless"}, {"==", "!=", ">", "<", ">=", "<="}, {"+", "-"}, {"*", "/", "%", "atan2"}, {"^"}]


@dataclass(frozen=True)
class Number:
    value: float


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Selector:
    matchers: tuple
    range_ms: int | None = None
    offset_ms: int = 0
    at: object = None  # milliseconds, "start" or "end"


@dataclass(frozen=True)
class Subquery:
    expr: object
    range_ms: int
    step_ms: int | None
    offset_ms: int = 0
    at: object = None


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Aggregate:
    op: str
    expr: object
    parameter: object = None
    by: tuple | None = None
    without: tuple | None = None


@dataclass(frozen=True)
class Unary:
    expr: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object
    bool_: bool = False
    on: tuple | None = None
    ignoring: tuple | None = None
    group: str | None = None
    include: tuple = field(default=())


def parse(query: str):
    c = Cursor(query)
    out = _binary(c, 0)
    c.end()
    return out


def _ms(text: str) -> int:
    return duration_ns(text) // 10**6


def _binary(c: Cursor, level: int):
    if level == len(LEVELS):
        return _postfix(c)
    if level == len(LEVELS) - 1 and c.is_("-", "+"):  # binds looser than ^
        minus = c.take().text == "-"
        inner = _binary(c, level)
        return Unary(inner) if minus else inner
    left = _binary(c, level + 1)
    while c.is_(*LEVELS[level]):
        op = c.take().text
        bool_ = bool(c.accept("bool"))
        on = ignoring = group = None
        include: tuple = ()
        if c.is_("on", "ignoring"):
            word = c.take().text
            names = tuple(name_list(c))
            on, ignoring = (names, None) if word == "on" else (None, names)
            if c.is_("group_left", "group_right"):
                group = c.take().text
                if c.is_("("):
                    include = tuple(name_list(c))
        right = _binary(c, level if op == "^" else level + 1)
        left = Binary(op, left, right, bool_, on, ignoring, group, include)
    return left


def _postfix(c: Cursor):
    e = _primary(c)
    while True:
        if c.accept("["):
            size = _ms(c.kind("duration"))
            if c.accept(":"):
                step = _ms(c.take().text) if c.now.kind == "duration" else None
                e = Subquery(e, size, step)
            elif isinstance(e, Selector):
                e = replace(e, range_ms=size)
            else:
                raise QueryError("only a selector has a range")
            c.expect("]")
        elif c.accept("offset"):
            minus = bool(c.accept("-"))
            shift = _ms(c.kind("duration"))
            e = replace(e, offset_ms=-shift if minus else shift)
        elif c.accept("@"):
            if c.is_("start", "end"):
                at = c.take().text
                c.expect("(")
                c.expect(")")
            else:
                at = int(float(c.kind("number")) * 1000)
            e = replace(e, at=at)
        else:
            return e


def _primary(c: Cursor):
    t = c.now
    if t.kind == "number":
        c.take()
        return Number(float(int(t.text, 16)) if t.text.startswith("0x") else float(t.text))
    if t.kind == "string":
        return Text(c.string())
    if c.accept("("):
        e = _binary(c, 0)
        c.expect(")")
        return e
    if c.accept("{"):
        return Selector(tuple(matchers(c)))
    name = c.kind("name")
    if name.lower() in ("inf", "nan") and not c.is_("{", "("):
        return Number(float(name))
    if name in AGGREGATES and c.is_("(", "by", "without"):
        return _aggregate(c, name)
    if c.accept("("):
        args = []
        while not c.accept(")"):
            args.append(_binary(c, 0))
            if not c.is_(")"):
                c.expect(",")
        return Call(name, tuple(args))
    more = matchers(c) if c.accept("{") else []
    return Selector((("__name__", "=", name), *more))


def _aggregate(c: Cursor, op: str) -> Aggregate:
    how: dict[str, tuple] = {}

    def grouping() -> None:
        if c.is_("by", "without"):
            word = c.take().text
            how[word] = tuple(name_list(c))

    grouping()
    c.expect("(")
    first = _binary(c, 0)
    parameter = None
    if op in WITH_PARAMETER:
        c.expect(",")
        parameter, first = first, _binary(c, 0)
    c.expect(")")
    grouping()
    return Aggregate(op, first, parameter, how.get("by"), how.get("without"))
