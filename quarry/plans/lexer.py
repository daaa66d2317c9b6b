"""One lexer for the query languages: strings, numbers with units, names and operators."""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass

_TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)
    |(?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`[^`]*`)
    |(?P<duration>\d+(?:\.\d+)?(?:ns|us|µs|ms|[smhdwy])(?:\d+(?:\.\d+)?(?:ns|us|µs|ms|[smhdwy]))*(?![A-Za-z0-9_]))
    |(?P<bytes>\d+(?:\.\d+)?(?:[KMGTP]i?B|[kmgtp]i?b|B)(?![A-Za-z0-9_]))
    |(?P<number>0x[0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
    |(?P<name>[A-Za-z_][A-Za-z0-9_:]*)
    |(?P<op>\|=|\|~|\|>|!>>|!<<|!>|!<|!~|!=|=~|==|>=|<=|&>>|&<<|&>|&<|&~|&&|\|\||>>|<<|[-+*/%^=<>!(){}\[\],.|@~:])""",
    re.X,
)


class QueryError(ValueError):
    """A query that can't be read or run."""


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int


class Cursor:
    def __init__(self, query: str):
        self.query, self.tokens, self.k = query, [], 0
        at = 0
        while at < len(query):
            m = _TOKEN.match(query, at)
            if not m:
                raise QueryError(f"unexpected {query[at]!r} at {at}")
            if m.lastgroup != "space":
                self.tokens.append(Token(m.lastgroup, m[0], at))
            at = m.end()
        self.tokens.append(Token("end", "", at))

    @property
    def now(self) -> Token:
        return self.tokens[self.k]

    def ahead(self, n: int = 1) -> Token:
        return self.tokens[min(self.k + n, len(self.tokens) - 1)]

    def is_(self, *texts: str) -> bool:
        return self.now.kind in ("op", "name") and self.now.text in texts

    def take(self) -> Token:
        t = self.now
        self.k += 1
        return t

    def accept(self, *texts: str) -> str | None:
        return self.take().text if self.is_(*texts) else None

    def expect(self, *texts: str) -> str:
        if not self.is_(*texts):
            raise QueryError(f"expected {' or '.join(texts)} at {self.now.at}, found {self.now.text or 'the end'!r}")
        return self.take().text

    def kind(self, *kinds: str) -> str:
        if self.now.kind not in kinds:
            raise QueryError(f"expected {' or '.join(kinds)} at {self.now.at}, found {self.now.text or 'the end'!r}")
        return self.take().text

    def string(self) -> str:
        t = self.kind("string")
        return t[1:-1] if t[0] == "`" else ast.literal_eval(t)

    def end(self) -> None:
        if self.now.kind != "end":
            raise QueryError(f"unexpected {self.now.text!r} at {self.now.at}")


def matchers(c: Cursor, names: str = "name") -> list[tuple[str, str, str]]:
    """{a="x", b=~"y"}, the brace already taken."""
    out = []
    while not c.accept("}"):
        name = c.string() if c.now.kind == "string" else c.kind(names)
        while c.accept("."):
            name += "." + c.kind("name")
        if out is not None and c.is_(",", "}"):
            out.append(("__name__", "=", name))
        else:
            out.append((name, c.expect("=", "!=", "=~", "!~"), c.string()))
        if not c.is_("}"):
            c.expect(",")
    return out


def name_list(c: Cursor) -> list[str]:
    c.expect("(")
    out = []
    while not c.accept(")"):
        out.append(c.kind("name"))
        c.accept(",")
    return out
