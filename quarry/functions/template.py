"""Line and label templates: ``text {{ .label | function argument }}`` compiled to a column."""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.lexer import QueryError
from . import labels as L
from . import numbers as N


def _num(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def _int(c: Column) -> Column:
    return F.coalesce(c.try_cast("double").try_cast("long"), F.lit(0))


def _fold(f, cast):
    def run(*a: Column) -> Column:
        out = cast(a[0])
        for x in a[1:]:
            out = f(out, cast(x))
        return N.text(out.cast("double"))

    return run


def _title(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def _trunc(n: Column, s: Column) -> Column:
    n = n.try_cast("int")
    return F.when(n >= 0, F.substring(s, F.lit(1), n)).otherwise(F.substring(s, F.greatest(F.lit(1), F.length(s) + n + 1), F.length(s)))


def _epoch(s: Column) -> Column:
    """Days, seconds, milli-, micro- or nanoseconds by the number of digits; null if it is none of them."""
    scale = F.create_map(*(F.lit(x) for k, v in {5: 86_400 * 10**9, 10: 10**9, 13: 10**6, 16: 10**3, 19: 1}.items() for x in (k, v)))
    return (s.try_cast("long") * scale[F.length(s)]).cast("string")


#: The piped value is the last argument.
FUNCTIONS = {
    "ToLower": F.lower, "ToUpper": F.upper, "lower": F.lower, "upper": F.upper, "title": _title,
    "trim": F.trim, "TrimSpace": F.trim,
    "Trim": lambda s, cut: F.btrim(s, cut), "TrimLeft": lambda s, cut: F.ltrim(s, cut), "TrimRight": lambda s, cut: F.rtrim(s, cut), "trimAll": lambda cut, s: F.btrim(s, cut),
    "TrimPrefix": lambda s, p: F.when(s.startswith(p), F.substring(s, F.length(p) + 1, F.length(s))).otherwise(s),
    "TrimSuffix": lambda s, p: F.when(s.endswith(p), F.substring(s, F.lit(1), F.length(s) - F.length(p))).otherwise(s),
    "trimPrefix": lambda p, s: F.when(s.startswith(p), F.substring(s, F.length(p) + 1, F.length(s))).otherwise(s),
    "trimSuffix": lambda p, s: F.when(s.endswith(p), F.substring(s, F.lit(1), F.length(s) - F.length(p))).otherwise(s),
    "Replace": lambda s, a, b, n: F.replace(s, a, b), "replace": lambda a, b, s: F.replace(s, a, b), "repeat": lambda n, s: F.repeat(s, n.try_cast("int")),
    "regexReplaceAll": lambda p, s, r: F.regexp_replace(s, p, r), "regexReplaceAllLiteral": lambda p, s, r: F.regexp_replace(s, p, F.replace(r, F.lit("$"), F.lit("\\$"))), "count": lambda p, s: F.regexp_count(s, p).cast("string"),
    "urldecode": F.url_decode, "urlencode": F.url_encode, "b64enc": lambda s: F.base64(s.cast("binary")), "b64dec": lambda s: F.unbase64(s).cast("string"),
    "bytes": lambda s: N.text(N.bytes_column(s)), "duration": lambda s: N.text(N.duration_column(s)), "duration_seconds": lambda s: N.text(N.duration_column(s)),
    "trunc": _trunc, "substr": lambda a, b, s: F.substring(s, a.try_cast("int") + 1, b.try_cast("int") - a.try_cast("int")),
    "contains": lambda p, s: s.contains(p).cast("string"), "hasPrefix": lambda p, s: s.startswith(p).cast("string"), "hasSuffix": lambda p, s: s.endswith(p).cast("string"),
    "indent": lambda n, s: F.regexp_replace(s, F.lit("(?m)^"), F.repeat(F.lit(" "), n.try_cast("int"))), "nindent": lambda n, s: F.concat(F.lit("\n"), F.regexp_replace(s, F.lit("(?m)^"), F.repeat(F.lit(" "), n.try_cast("int")))),
    "alignLeft": lambda n, s: F.rpad(s, n.try_cast("int"), F.lit(" ")), "alignRight": lambda n, s: F.when(F.length(s) > n.try_cast("int"), _trunc(F.concat(F.lit("-"), n), s)).otherwise(F.lpad(s, n.try_cast("int"), F.lit(" "))),
    "int": lambda s: _int(s).cast("string"), "float64": lambda s: N.text(_num(s)),
    "add": _fold(lambda a, b: a + b, _int), "sub": _fold(lambda a, b: a - b, _int), "mul": _fold(lambda a, b: a * b, _int),
    "div": lambda a, b: F.when(_int(b) != 0, F.try_divide(_int(a) - _int(a) % F.nullif(_int(b), F.lit(0)), _int(b))).cast("long").cast("string"), "mod": lambda a, b: F.when(_int(b) != 0, _int(a) % F.nullif(_int(b), F.lit(0))).cast("string"),
    "addf": _fold(lambda a, b: a + b, _num), "subf": _fold(lambda a, b: a - b, _num), "mulf": _fold(lambda a, b: a * b, _num), "divf": _fold(N.div, _num),
    "max": _fold(F.greatest, _int), "min": _fold(F.least, _int), "maxf": _fold(F.greatest, _num), "minf": _fold(F.least, _num),
    "ceil": lambda s: N.text(F.ceil(_num(s)).cast("double")), "floor": lambda s: N.text(F.floor(_num(s)).cast("double")), "round": lambda s, n=None: N.text(F.round(_num(s)) if n is None else F.floor(_num(s) * F.pow(F.lit(10.0), _num(n)) + 0.5) / F.pow(F.lit(10.0), _num(n))),
    "default": lambda d, s: F.when(F.coalesce(s, F.lit("")) == "", d).otherwise(s), "urlquery": F.url_encode,
    "unixEpoch": lambda s: N.floor_div(s.try_cast("long"), 10**9).cast("string"), "unixEpochMillis": lambda s: N.floor_div(s.try_cast("long"), 10**6).cast("string"), "unixEpochNanos": lambda s: s,
    "unixToTime": _epoch,
}
#: Parts of a time layout and their patterns, longest first.
LAYOUT = [("2006", "yyyy"), ("January", "MMMM"), ("Monday", "EEEE"), (".000000", ".SSSSSS"), (".000", ".SSS"), ("Z07:00", "XXX"), ("-0700", "xx"), ("MST", "z"), ("Jan", "MMM"), ("Mon", "EEE"), ("01", "MM"), ("02", "dd"), ("15", "HH"), ("03", "hh"), ("04", "mm"), ("05", "ss"), ("PM", "a")]


def layout(text: str) -> str:
    return re.sub("|".join(re.escape(a) for a, _ in LAYOUT) + "|[A-Za-z]+", lambda m: dict(LAYOUT).get(m[0], f"'{m[0]}'"), text)


@dataclass(frozen=True)
class Term:
    """A value in a template: text, number, bool, time (nanoseconds as text) or json (text of a JSON value)."""

    column: Column
    kind: str = "text"
    constant: str | None = None

    @property
    def true(self) -> Column:
        if self.kind == "number":
            return F.coalesce(_num(self.column) != 0, F.lit(False))
        if self.kind == "bool":
            return F.coalesce(self.column == "true", F.lit(False))
        empty = ("", "null", "false", "[]", "{}") if self.kind == "json" else ("",)
        return ~F.coalesce(self.column, F.lit("")).isin(*empty)

    @property
    def text(self) -> Column:
        if self.kind != "time":
            return self.column
        at, ns = F.timestamp_seconds(N.floor_div(self.column.try_cast("long"), 10**9)), F.pmod(self.column.try_cast("long"), F.lit(10**9))
        part = F.when(ns > 0, F.concat(F.lit("."), F.rtrim(F.lpad(ns.cast("string"), 9, "0"), F.lit("0")))).otherwise("")
        return F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), part, F.lit(" +0000 UTC"))


NUMBERS = {"add", "sub", "mul", "div", "mod", "addf", "subf", "mulf", "divf", "max", "min", "maxf", "minf", "ceil", "floor", "round", "int", "float64", "count", "len", "bytes", "duration", "duration_seconds"}
BOOLS = {"contains", "hasPrefix", "hasSuffix"}
TIMES = {"unixToTime", "toDate", "toDateInZone", "now"}
COMPARES = {"eq": "==", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
_ACTION = re.compile(r"\{\{(-\s)?((?:\"(?:\\.|[^\"\\])*\"|`[^`]*`|.)*?)(\s-)?\}\}", re.S)
_WORD = re.compile(r"\"(?:\\.|[^\"\\])*\"|`[^`]*`|[()|,]|:=|=|[^\s()|,\"`]+")


def compile(template: str, labels: Column, line: Column, ts_ns: Column) -> Column:
    """The template over a row's labels, line and time: text, {{ pipelines }}, if, with, range, else, end, $variables.

    The result is null where the template fails on a row.
    """
    return _Template(template, labels, line, ts_ns).text()


class _Template:
    def __init__(self, template: str, labels: Column, line: Column, ts_ns: Column):
        self.labels, self.line, self.ts_ns = labels, line, ts_ns
        self.parts: list[tuple[bool, str]] = []
        at = 0
        for m in _ACTION.finditer(template):
            before = template[at : m.start()]
            self.parts += [(False, before.rstrip() if m[1] else before), (True, m[2].strip())]
            at = m.end()
            if m[3]:
                at += len(template[at:]) - len(template[at:].lstrip())
        self.parts.append((False, template[at:]))
        self.k = 0

    def text(self) -> Column:
        out, stop = self._body(None, {})
        if stop:
            raise QueryError(f"unexpected {stop} in a template")
        return out

    def _body(self, dot: Term | None, names: dict[str, Term]) -> tuple[Column, str]:
        """The text up to the action that ends it (end or else ..., empty at the end of all)."""
        out: list[Column] = []
        while self.k < len(self.parts):
            action, text = self.parts[self.k]
            self.k += 1
            if not action:
                out += [F.lit(text)] if text else []
                continue
            word, _, rest = text.partition(" ")
            if word in ("end", "else"):
                return (F.concat(*out) if out else F.lit("")), text
            if text.startswith("/*"):
                continue
            if word in ("if", "with", "range"):
                out.append(self._block(word, rest, dot, names))
            elif m := re.match(r"(\$\w+)\s*:?=\s*(.*)", text, re.S):
                names[m[1]] = self._pipe(m[2], dot, names)
            else:
                out.append(self._pipe(text, dot, names).text)
        return (F.concat(*out) if out else F.lit("")), ""

    def _block(self, word: str, rest: str, dot: Term | None, names: dict[str, Term]) -> Column:
        m = re.match(r"((?:\$\w+)(?:\s*,\s*\$\w+)?)\s*:=\s*(.*)", rest, re.S)
        variables, pipe = ([v.strip() for v in m[1].split(",")], m[2]) if m else ([], rest)
        value = self._pipe(pipe, dot, names)
        start = self.k
        if word == "range":
            items = F.from_json(value.column, "array<string>")

            def each(e: Column, i: Column) -> Column:
                self.k = start
                own = names | dict(zip(variables[::-1], (Term(e, "json"), Term(i.cast("string"), "number")), strict=False))
                return self._body(Term(e, "json"), own)[0]

            made, test = F.array_join(F.transform(items, each), ""), F.coalesce(F.size(items), F.lit(0)) > 0
            self.k = start
            stop = self._body(Term(F.lit(""), "json"), names | {v: Term(F.lit("")) for v in variables})[1]
        else:
            made, stop = self._body(value if word == "with" else dot, names | {v: value for v in variables})
            test = value.true
        other = F.lit("")
        if stop.startswith("else"):
            more = stop[4:].strip()
            if more:
                kind, _, rest = more.partition(" ")
                return F.when(test, made).otherwise(self._block(kind, rest, dot, names))
            other, stop = self._body(dot, dict(names))
        if stop != "end":
            raise QueryError(f"{word} without end in a template")
        return F.when(test, made).otherwise(other)

    def _pipe(self, text: str, dot: Term | None, names: dict[str, Term]) -> Term:
        words = _WORD.findall(text)
        value, words = self._commands(words, dot, names)
        if words:
            raise QueryError(f"unexpected {words[0]} in a template")
        return value

    def _commands(self, words: list[str], dot: Term | None, names: dict[str, Term]) -> tuple[Term, list[str]]:
        """A pipeline up to a closing bracket: each command's value is the last argument of the next."""
        value: Term | None = None
        while True:
            name, args = None, []
            while words and words[0] not in ("|", ")"):
                w = words.pop(0)
                if w == "(":
                    inner, words = self._commands(words, dot, names)
                    if not words or words.pop(0) != ")":
                        raise QueryError("a bracket is open in a template")
                    while words and re.match(r"\.\w", words[0]):
                        inner = self._fields(inner, words.pop(0))
                    args.append(inner)
                elif name is None and not args and re.fullmatch(r"[A-Za-z]\w*", w) and w not in ("true", "false", "nil"):
                    name = w
                else:
                    args.append(self._term(w, dot, names))
            if value is not None:
                args.append(value)
            if name is None and len(args) != 1:
                raise QueryError("a function is missing in a template")
            value = self._call(name, args) if name else args[0]
            if words and words[0] == "|":
                words.pop(0)
                continue
            return value, words

    def _fields(self, of: Term, path: str) -> Term:
        if of.kind == "time":
            method = path.lstrip(".")
            divide = {"Unix": 10**9, "UnixMilli": 10**6, "UnixMicro": 10**3, "UnixNano": 1}
            if method not in divide:
                raise QueryError(f"unknown method {method}")
            return Term(N.floor_div(of.column.try_cast("long"), divide[method]).cast("string"), "number")
        return Term(F.coalesce(F.get_json_object(of.column, "$" + path), F.lit("")), "json")

    def _term(self, w: str, dot: Term | None, names: dict[str, Term]) -> Term:
        if w[0] in "\"`":
            text = w[1:-1] if w[0] == "`" else ast.literal_eval(w)
            return Term(F.lit(text), "text", text)
        if m := re.fullmatch(r"(\$\w+|__timestamp__|__line__)((?:\.\w+)*)", w):
            of = {"__timestamp__": Term(self.ts_ns.cast("string"), "time"), "__line__": Term(self.line)}.get(m[1]) or names.get(m[1])
            if of is None:
                raise QueryError(f"unknown variable {m[1]}")
            return self._fields(of, m[2]) if m[2] else of
        if w.startswith("$."):
            return Term(L.get(self.labels, w[2:]))
        if w == ".":
            return dot or Term(F.to_json(self.labels), "json")
        if w.startswith("."):
            return self._fields(dot, w) if dot is not None and dot.kind == "json" else Term(L.get(self.labels, w[1:]))
        if re.fullmatch(r"[-+]?[\d.]+(e[-+]?\d+)?", w):
            return Term(F.lit(w), "number")
        if w in ("true", "false"):
            return Term(F.lit(w), "bool")
        raise QueryError(f"can't read {w} in a template")

    def _call(self, name: str, args: list[Term]) -> Term:
        columns = [a.column for a in args]
        if name in ("and", "or"):
            out = args[-1].column
            for a in args[-2::-1]:
                out = F.when(a.true, out if name == "and" else a.column).otherwise(a.column if name == "and" else out)
            return Term(out, args[-1].kind)
        if name == "not":
            return Term((~args[0].true).cast("string"), "bool")
        if name in COMPARES:
            a, b = args
            x, y = (_num(a.column), _num(b.column)) if "number" in (a.kind, b.kind) else (a.column, b.column)
            return Term({"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[COMPARES[name]].cast("string"), "bool")
        if name == "printf":
            return Term(_printf(args))
        if name in ("print", "println"):
            return Term(F.concat_ws(" " if name == "println" else "", *(a.text for a in args), *([F.lit("\n")] if name == "println" else [])))
        if name == "len":
            return Term(F.octet_length(columns[0]).cast("string"), "number")
        if name == "index":
            return self._fields(args[0], "." + _text(args[1])) if args[0].kind == "json" else Term(L.get(self.labels, _text(args[1])))
        if name == "fromJson":
            return Term(columns[0], "json")
        if name == "now":
            return Term((F.unix_micros(F.current_timestamp()) * 1000).cast("string"), "time")
        if name == "date":
            return Term(F.date_format(F.timestamp_micros(N.floor_div(columns[1].try_cast("long"), 1000)), layout(_text(args[0]))))
        if name in ("toDate", "toDateInZone"):
            at = F.try_to_timestamp(columns[-1], F.lit(layout(_text(args[0]))))
            if name == "toDateInZone":
                at = F.to_utc_timestamp(at, _text(args[1]))
            return Term((F.unix_micros(at) * 1000).cast("string"), "time")
        if name not in FUNCTIONS:
            raise QueryError(f"unknown template function {name}")
        kind = "number" if name in NUMBERS else "bool" if name in BOOLS else "time" if name in TIMES else "text"
        return Term(FUNCTIONS[name](*columns), kind)


def _text(t: Term) -> str:
    """A constant argument."""
    if t.constant is None:
        raise QueryError("this argument of a template function must be a constant")
    return t.constant


def _printf(args: list[Term]) -> Column:
    """%s %v %q %d %x %f %e %g with flags, width and precision."""
    out, rest = [], list(args[1:])
    for text, flags, verb in re.findall(r"([^%]+)|%([-+# 0]*\d*(?:\.\d+)?)([a-zA-Z%])", _text(args[0])):
        if text:
            out.append(F.lit(text))
        elif verb == "%":
            out.append(F.lit("%"))
        elif not rest:
            out.append(F.lit(f"%!{verb}(MISSING)"))
        else:
            a = rest.pop(0)
            if verb in "dxX":
                out.append(F.format_string(f"%{flags}{verb}", _int(a.column)))
            elif verb in "feEgG":
                out.append(F.format_string(f"%{flags}{verb}", _num(a.column)))
            elif verb == "q":
                out.append(F.concat(F.lit('"'), F.regexp_replace(a.text, r'(["\\\\])', r"\\$1"), F.lit('"')))
            else:
                out.append(F.format_string(f"%{flags}s", a.text) if flags else a.text)
    return F.concat(*out) if out else F.lit("")
