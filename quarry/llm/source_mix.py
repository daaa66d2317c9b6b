"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by the set of sources they belong to (their membership pattern). A flow network
routes words from each pattern to the sources of its set: a pattern's words may be taken once at no cost,
a second time at cost 1, a third at cost 2 (convex, so repetition is the last resort and is spread), and
a source takes no more than its target. The flow of a pattern becomes documents: each whole repetition
takes all of them, and the rest is taken in the order of a seeded hash until the pattern's flow is met.

Only sums for each pattern go to the driver (bounded by ``MAX_PATTERNS``, checked). The cut in hash order
is found from sums over 4,096 slices of the hash range, three times over, so no pattern's documents ever
meet in one task: what a cut misses is one slice of 2**-36 of the hash range, a document at most in practice.

Input columns named like a column of the result are replaced by it.
Edge cases: null text has size 0 and is never taken (it has no words); a null source is a source of its own,
last in order; an empty table gives no rows; repeated rows are taken alike; other columns are kept.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

WEIGHTS = (5, 2, 1)
TIMES = 3
MAX_PATTERNS = 200_000
SLICES = 4096


def targets(sizes: list[int], weights: list[float], times: int = TIMES) -> list[float]:
    """Shares of the sum of all sizes by weight; none above ``times`` its size, the excess dealt again by weight."""
    left, open_, out = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while open_ and left > 0:
        whole = sum(weights[k] for k in open_)
        full = [k for k in open_ if left * weights[k] / whole >= times * sizes[k]]
        if not full:
            for k in open_:
                out[k] = left * weights[k] / whole
            break
        for k in full:
            out[k] = float(times * sizes[k])
        left -= sum(out[k] for k in full)
        open_ -= set(full)
    return out


def min_cost_flow(patterns: list[tuple[int, ...]], words: list[int], quotas: list[int], times: int = TIMES) -> list[dict[int, int]]:
    """For each pattern the words routed to each of its sources, at most ``times`` its own.

    Successive shortest paths; costs are those of repetition. The network has a node for each pattern and
    source, so it doesn't grow with the documents.
    """
    n_p, n_s = len(patterns), len(quotas)
    head: list[list[int]] = [[] for _ in range(n_p + n_s + 2)]
    to, cap, cost = [], [], []

    def arc(u: int, v: int, c: int, w: int) -> int:
        for a, b, x, y in ((u, v, c, w), (v, u, 0, -w)):
            head[a].append(len(to))
            to.append(b)
            cap.append(x)
            cost.append(y)
        return len(to) - 2

    start, end = n_p + n_s, n_p + n_s + 1
    routes: list[dict[int, int]] = []
    for p, of in enumerate(patterns):
        for k in range(times):
            arc(start, p, words[p], k)
        routes.append({s: arc(p, n_p + s, times * words[p], 0) for s in of})
    for s, q in enumerate(quotas):
        arc(n_p + s, end, q, 0)
    while True:
        far, by, queue, inside = [float("inf")] * len(head), [-1] * len(head), deque([start]), [False] * len(head)
        far[start] = 0
        while queue:
            u = queue.popleft()
            inside[u] = False
            for e in head[u]:
                if cap[e] and far[u] + cost[e] < far[to[e]]:
                    far[to[e]], by[to[e]] = far[u] + cost[e], e
                    if not inside[to[e]]:
                        inside[to[e]] = True
                        queue.append(to[e])
        if by[end] < 0:
            return [{s: cap[e ^ 1] for s, e in r.items()} for r in routes]
        path, v = [], end
        while v != start:
            path.append(by[v])
            v = to[by[v] ^ 1]
        most = min(cap[e] for e in path)
        for e in path:
            cap[e] -= most
            cap[e ^ 1] += most


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, times: int = TIMES, seed: int = 0, sources: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with size, source_size, target and taken (words, repeats counted).

    ``sources`` names an array column with all sources of a document; by default it is the one in ``source``.
    For a document of several sources, source_size and target are those of the first by name.
    """
    spark = docs.sparkSession
    ws = Workspace(spark)
    keep = tuple(c for c in keep if c not in ("size", "source_size", "target", "taken"))
    of = F.col(sources) if sources else F.array("source")
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = docs.select(*keep, F.array_sort(F.array_distinct(of)).alias("mix:of"), size.alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("mix:h"))
    rows = ws.keep(rows, "sizes")
    found = rows.groupBy("mix:of").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} sets of sources")
    found.sort(key=lambda r: [(s is None, s or "") for s in r["mix:of"]])
    names = sorted({s for r in found for s in r["mix:of"]}, key=lambda s: (s is None, s or ""))
    at = {s: k for k, s in enumerate(names)}
    sizes = [sum(r["size"] for r in found if s in r["mix:of"]) for s in names] if sources else [r["size"] for r in found]
    goal = targets(sizes, [weights[k % len(weights)] for k in range(len(names))], times)
    patterns, words = [tuple(at[s] for s in r["mix:of"]) for r in found], [r["size"] for r in found]
    flow = [sum(r.values()) for r in min_cost_flow(patterns, words, [round(g) for g in goal], times)]

    plan = [(list(r["mix:of"]), k, sizes[p[0]] if p else 0, goal[p[0]] if p else 0.0, f // w if w else 0, f % w if w else 0) for k, (r, p, f, w) in enumerate(zip(found, patterns, flow, words, strict=True))]
    plan = spark.createDataFrame(plan, "`mix:of` array<string>, `mix:k` int, source_size long, target double, `mix:whole` int, `mix:rest` long")
    joined = rows.join(F.broadcast(plan), "mix:of", "left")  # no more rows than MAX_PATTERNS

    # in [0, 2**36): the place in hash order; the cut is narrowed to one value, slice by slice
    place = F.shiftrightunsigned("mix:h", 28)
    low = plan.select("mix:k", F.lit(0).cast("long").alias("mix:low"), F.col("mix:rest").alias("mix:left"))
    keyed = joined.select("mix:k", "size", place.alias("mix:place")).where("size > 0")
    for step in (24, 12, 0):
        near = keyed.join(F.broadcast(low), "mix:k").where(F.shiftright("mix:place", step + 12) == F.shiftright("mix:low", step + 12))
        sums = near.groupBy("mix:k", F.shiftright("mix:place", step).alias("mix:slice"), "mix:left").agg(F.sum("size").alias("n"))
        per = sums.groupBy("mix:k", "mix:left").agg(F.sort_array(F.collect_list(F.struct("mix:slice", "n"))).alias("all"))  # SLICES entries at most
        made = []
        for r in per.collect():
            total, cut = 0, r["all"][-1]["mix:slice"] + 1
            for x in r["all"]:
                if total + x["n"] > r["mix:left"]:
                    cut = x["mix:slice"]
                    break
                total += x["n"]
            made.append((r["mix:k"], cut << step, r["mix:left"] - total))
            if step == 0:
                nearer = r["mix:left"] - total > (total + next((x["n"] for x in r["all"] if x["mix:slice"] == cut), 0)) - r["mix:left"]
                made[-1] = (r["mix:k"], cut + nearer, 0)
        low = spark.createDataFrame(made or [(-1, 0, 0)], "`mix:k` int, `mix:low` long, `mix:left` long")
    cut = low.select("mix:k", F.col("mix:low").alias("mix:cut"))
    out = joined.join(F.broadcast(cut), "mix:k", "left")
    times_taken = F.least(F.lit(times), F.coalesce("mix:whole", F.lit(0)) + F.when((F.col("mix:rest") > 0) & (place < F.coalesce("mix:cut", F.lit(0))), 1).otherwise(0))
    return out.select(*keep, "size", F.coalesce("source_size", F.lit(0)).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), (F.col("size") * times_taken).alias("taken"))

