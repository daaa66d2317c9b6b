"""Profile selectors: type{label="x"}."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .lexer import Cursor, QueryError, matchers


@dataclass(frozen=True)
class ProfileType:
    name: str
    sample_type: str
    sample_unit: str
    period_type: str
    period_unit: str
    delta: bool = False


def parse_type(text: str) -> ProfileType:
    parts = text.split(":")
    if len(parts) not in (5, 6) or len(parts) == 6 and parts[5] != "delta" or not all(parts):
        raise QueryError(f"not a profile type: {text}")
    return ProfileType(*parts[:5], delta=len(parts) == 6)


def parse(query: str) -> tuple[str | None, tuple]:
    """The profile type, if one is given, and the matchers."""
    m = re.match(r"\s*([A-Za-z0-9_:]*)\s*(\{.*)?$", query, re.S)
    if not m:
        raise QueryError("not a profile selector")
    kind, rest = m[1] or None, m[2]
    if kind:
        parse_type(kind)
    if not rest:
        return kind, ()
    c = Cursor(rest)
    c.expect("{")
    out = tuple(matchers(c))
    c.end()
    named = [t for n, op, t in out if n == "__profile_type__" and op == "="]
    return kind or (named[0] if named else None), tuple(x for x in out if x[0] != "__profile_type__")
