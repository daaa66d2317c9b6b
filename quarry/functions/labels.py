"""Label sets as MAP<STRING, STRING>: matching, keeping, dropping and a canonical key."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NAME = "__name__"
EMPTY = "map<string,string>"


class Wide(dict):
    """Some labels of a row as a column each, null where it has no such label; others are not kept."""


def empty() -> Column:
    return F.create_map().cast(EMPTY)


def key(labels: Column) -> Column:
    """A string that is equal for equal label sets, whatever the order of entries; maps can't be joined or windowed."""
    return F.to_json(F.array_sort(F.map_entries(labels)))


def of_key(k: Column) -> Column:
    """The labels that key() was made from."""
    return F.map_from_entries(F.from_json(k, "array<struct<key:string,value:string>>"))


def has(labels: Column | Wide, name: str) -> Column:
    return labels[name].isNotNull() if isinstance(labels, Wide) else F.map_contains_key(labels, name)


def choose(test: Column, a: Column | Wide, b: Column | Wide) -> Column | Wide:
    return Wide({n: b[n] if a[n] is b[n] else F.when(test, a[n]).otherwise(b[n]) for n in b}) if isinstance(b, Wide) else F.when(test, a).otherwise(b)


def those(labels: Column | Wide, test) -> Column | Wide:
    """The labels for whose name and value it holds."""
    return Wide({n: F.when(test(F.lit(n), v), v) for n, v in labels.items()}) if isinstance(labels, Wide) else F.map_filter(labels, test)


def whole_map(labels: Wide) -> Column:
    made = F.create_map(*(x for n, v in labels.items() for x in (F.lit(n), v))) if labels else empty()
    return F.map_filter(made, lambda k, v: v.isNotNull())


def get(labels: Column | Wide, name: str) -> Column:
    """A missing label is the empty string."""
    return F.coalesce(labels[name], F.lit(""))


def keep(labels: Column, names: list[str]) -> Column:
    return F.map_filter(labels, lambda k, v: k.isin(names)) if names else empty()


def drop(labels: Column | Wide, names: list[str]) -> Column | Wide:
    if isinstance(labels, Wide):
        return Wide({n: F.lit(None).cast("string") if n in names else v for n, v in labels.items()})
    return F.map_filter(labels, lambda k, v: ~k.isin(names)) if names else labels


def put(labels: Column | Wide, name: str, value: Column) -> Column | Wide:
    """labels with name set; the empty string deletes it."""
    if isinstance(labels, Wide):
        return Wide({n: F.nullif(value, F.lit("")) if n == name else v for n, v in labels.items()})
    rest = drop(labels, [name])
    return F.when(F.coalesce(value, F.lit("")) == "", rest).otherwise(F.map_concat(rest, F.create_map(F.lit(name), value)))


def merge(labels: Column, other: Column) -> Column:
    """labels overwritten by other."""
    return F.map_concat(F.map_filter(labels, lambda k, v: ~F.map_contains_key(other, k)), other)


def java(pattern: str) -> str:
    """An RE2 pattern for java.util.regex."""
    return pattern.replace("(?P<", "(?<")


def whole(pattern: str) -> str:
    """A pattern that must match from the first character to the very last; ``$`` would stop before a final newline."""
    return rf"\A(?s:{java(pattern)})\z"


def match(value: Column, op: str, text: str, anchored: bool = True) -> Column:
    """= != =~ !~ of a matcher; regexes are fully anchored unless said otherwise."""
    if op in ("=", "!="):
        return value == text if op == "=" else value != text
    hit = value.rlike(whole(text) if anchored else java(text))
    return hit if op == "=~" else ~hit


def label_name(name: str) -> str:
    """A key as a label: other characters than letters, digits and _ become _; a leading digit gets one before it."""
    out = re.sub(r"[^A-Za-z0-9_]", "_", name)
    return "_" + out if out[:1].isdigit() else out


def label_names(labels: Column) -> Column:
    def one(k: Column, v: Column) -> Column:
        s = F.regexp_replace(k, "[^A-Za-z0-9_]", "_")
        return F.when(s.rlike("^[0-9]"), F.concat(F.lit("_"), s)).otherwise(s)

    return F.transform_keys(labels, one)
