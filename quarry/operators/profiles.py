"""Profiles: samples (profile_type, labels MAP, ts_ns, stack ARRAY<STRING> root first, value) to trees and series."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import numbers as N
from ..plans import profileql as Q

SEP = "\x1f"


class ProfileEngine:
    def __init__(self, samples: DataFrame):
        self.samples = samples

    def select(self, query: str, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
        kind, tests = Q.parse(query)
        df = self.samples.where(F.col("profile_type") == kind) if kind else self.samples
        for name, op, text in tests:
            df = df.where(L.match(L.get(F.col("labels"), name), op, text))
        return df.where(F.col("ts_ns").between(start_ns, end_ns)) if start_ns is not None else df

    def tree(self, query: str, **time) -> DataFrame:
        """(path, name, depth, self, total) of each node; the root has the empty path. One row a stack is exploded."""
        rows = self.select(query, **time).groupBy("stack").agg(F.sum("value").alias("value"))  # equal stacks meet first
        n = F.size("stack")
        nodes = rows.select(F.explode(F.transform(F.sequence(F.lit(0), n), lambda d: F.struct(F.array_join(F.slice("stack", F.lit(1), d), SEP).alias("path"), d.alias("depth"), F.when(d == n, F.col("value")).otherwise(0).alias("own")))).alias("x"), "value")
        return nodes.groupBy("x.path", "x.depth").agg(F.sum("x.own").alias("self"), F.sum("value").alias("total")).withColumn("name", F.when(F.col("depth") == 0, "total").otherwise(F.element_at(F.split("path", SEP), -1)))

    def folded(self, query: str, max_nodes: int, **time) -> DataFrame:
        """The tree with nodes below the max_nodes-th largest total folded into an ``other`` child of their parent."""
        tree = self.tree(query, **time)
        least = tree.orderBy(F.col("total").desc()).limit(max_nodes).agg(F.min("total").alias("least"))
        rows = tree.crossJoin(F.broadcast(least))  # one row
        kept = rows.where("total >= least or depth = 0").select("path", "depth", "name", "self", "total")
        parent = F.when(F.col("depth") == 1, "").otherwise(F.regexp_replace("path", f"{SEP}[^{SEP}]*$", ""))
        small = rows.where("total < least and depth > 0").withColumn("parent", parent)
        top = small.join(kept.select(F.col("path").alias("parent")), "parent", "left_semi").groupBy("parent", "depth").agg(F.sum("total").alias("total"))
        other = top.select(F.concat_ws(SEP, F.nullif("parent", F.lit("")), F.lit("other")).alias("path"), "depth", F.lit("other").alias("name"), F.col("total").alias("self"), "total")
        return kept.unionByName(other)

    def collapsed(self, query: str, **time) -> DataFrame:
        return self.select(query, **time).groupBy(F.array_join("stack", ";").alias("stack")).agg(F.sum("value").alias("value"))

    def pprof(self, query: str, **time) -> DataFrame:
        """The rows of a pprof sample table: (locations, value), leaf first."""
        return self.select(query, **time).groupBy("stack").agg(F.sum("value").alias("value")).select(F.array_join(F.reverse("stack"), ";").alias("locations"), "value")

    def series(self, query: str, start_ms: int, end_ms: int, step_ms: int) -> DataFrame:
        """Sums in half-open buckets [start + k step, ...)."""
        ts = N.floor_div(F.col("ts_ns"), 10**6)
        df = self.select(query).where((ts >= start_ms) & (ts < end_ms))
        return df.groupBy((F.lit(start_ms) + N.floor_div(ts - start_ms, step_ms) * step_ms).alias("step_ms")).agg(F.sum("value").cast("double").alias("value"))

    def types(self) -> DataFrame:
        return self.samples.select("profile_type").distinct()

    def label_names(self) -> DataFrame:
        return self.samples.select(F.explode(F.map_keys("labels")).alias("name")).distinct()

    def label_values(self, name: str) -> DataFrame:
        return self.samples.select(F.col("labels")[name].alias("value")).where("value is not null").distinct()


def flamebearer(nodes: list[tuple[str, int, int, int]]) -> tuple[list[str], list[list[int]]]:
    """Names and levels of a tree (path, depth, self, total) of bounded size: 4 numbers a node, x offsets as differences."""
    by: dict[str, list[tuple[str, int, int, int]]] = {}
    for path, depth, own, total in sorted(nodes):
        if depth:
            by.setdefault(SEP.join(path.split(SEP)[:-1]), []).append((path, depth, own, total))
    root = next(n for n in nodes if n[1] == 0)
    names, index, levels, ends = ["total"], {"total": 0}, [], []
    todo = [(root, 0)]
    while todo:
        (path, depth, own, total), x = todo.pop()
        while len(levels) <= depth:
            levels.append([])
            ends.append(0)
        name = path.split(SEP)[-1] if depth else "total"
        if name not in index:
            index[name] = len(names)
            names.append(name)
        levels[depth] += [x - ends[depth], total, own, index[name]]
        ends[depth] = x + total
        at, below = x + own, []
        for child in by.get(path, []):
            below.append((child, at))
            at += child[3]
        todo += reversed(below)
    return names, levels


def html(names: list[str], levels: list[list[int]], title: str = "profile") -> str:
    """A flame graph as a page: a bar for each node of a flamebearer, as wide as its share of the total."""
    total, bars = max(1, levels[0][1] if levels else 1), []
    for depth, row in enumerate(levels):
        x = 0
        for k in range(0, len(row), 4):
            x += row[k]
            width, own, name = row[k + 1], row[k + 2], escape(names[row[k + 3]])
            bars.append(f'<div style="left:{100 * x / total:.4f}%;width:{100 * width / total:.4f}%;top:{18 * depth}px" title="{name}: {width} ({own} own)">{name}</div>')
            x += width
    style = "div{position:absolute;height:17px;overflow:hidden;font:12px monospace;background:#f4b183;outline:1px solid #fff}"
    return f"<!doctype html><title>{escape(title)}</title><style>{style}</style><body>{''.join(bars)}</body>"
