"""Windows that overlap many times: every sample goes to one or two chunks of steps, not to each step that it covers.

A chunk is a series' samples for a run of steps, of a span fixed by the query: what a task holds grows with the rate of
samples, not with the length of a series or the number of steps. Chunks are reduced with numpy over Arrow batches; each
window is summed on its own (no running differences), so NaN and infinity stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..session import ship
from .grid import Grid

#: Steps of a chunk at least, and how many windows long it is.
STEPS, WINDOWS = 1024, 4


class Slice:
    """Windows lo:hi (never empty) over a chunk's samples in time, and the step that each ends at."""

    def __init__(self, ts: np.ndarray, v: np.ndarray, lo: np.ndarray, hi: np.ndarray, t: np.ndarray, window: int):
        self.ts, self.v, self.lo, self.hi, self.t, self.window, self.n = ts, v, lo, hi, t, window, hi - lo

    def reduce(self, op: np.ufunc, values: np.ndarray, skip: int = 0, none: float = 0.0) -> np.ndarray:
        """op over each window's values, without its first ``skip``."""
        lo, out = self.lo + skip, np.full(len(self.lo), none)
        some = lo < self.hi
        at = np.stack([lo[some], self.hi[some]], 1).ravel()
        out[some] = op.reduceat(np.append(values, none), at)[::2] if some.any() else none
        return out

    def sum(self, values: np.ndarray, skip: int = 0) -> np.ndarray:
        return self.reduce(np.add, values, skip)

    def variance(self) -> np.ndarray:
        known = self.v[np.isfinite(self.v)]
        x = self.v - (known.mean() if len(known) else 0.0)
        return np.maximum(self.sum(x * x) / self.n - (self.sum(x) / self.n) ** 2, 0.0)

    def steps(self, test: Callable) -> np.ndarray:
        """test(before, now) of neighbours, at the later one."""
        out = np.zeros(len(self.v))
        out[1:] = test(self.v[:-1], self.v[1:])
        return out

    def extrapolated(self, counter: bool, rate: bool) -> np.ndarray:
        first, last = self.v[self.lo], self.v[self.hi - 1]
        moved = last - first + (self.sum(self.steps(lambda a, b: np.where(a > b, a, 0.0)), 1) if counter else 0)
        took = (self.ts[self.hi - 1] - self.ts[self.lo]) / 1000.0
        gap = took / (self.n - 1)
        before, after = (self.ts[self.lo] - (self.t - self.window)) / 1000.0, (self.t - self.ts[self.hi - 1]) / 1000.0
        before, after = (np.where(x >= gap * 1.1, gap / 2, x) for x in (before, after))
        if counter:
            before = np.where((moved > 0) & (first >= 0), np.minimum(before, took * (first / moved)), before)
        out = moved * ((took + before + after) / took)
        return np.where((self.n > 1) & (took > 0), out / (self.window / 1000.0) if rate else out, np.nan)

    def instant(self, counter: bool) -> np.ndarray:
        last, before = self.v[self.hi - 1], self.v[np.maximum(self.hi - 2, 0)]
        took = (self.ts[self.hi - 1] - self.ts[np.maximum(self.hi - 2, 0)]) / 1000.0
        return np.where(counter & (last < before), last, last - before) / (took if counter else 1)


#: Functions over a slice; those that need two samples are left out where there is one.
FUNCTIONS: dict[str, Callable[[Slice], np.ndarray]] = {
    "count_over_time": lambda s: s.n.astype(float), "sum_over_time": lambda s: s.sum(s.v), "avg_over_time": lambda s: s.sum(s.v) / s.n,
    "min_over_time": lambda s: s.reduce(np.fmin, s.v, none=np.nan), "max_over_time": lambda s: s.reduce(np.fmax, s.v, none=np.nan),
    "last_over_time": lambda s: s.v[s.hi - 1], "first_over_time": lambda s: s.v[s.lo], "present_over_time": lambda s: np.ones(len(s.lo)),
    "stdvar_over_time": Slice.variance, "stddev_over_time": lambda s: np.sqrt(s.variance()),
    "rate": lambda s: s.extrapolated(True, True), "increase": lambda s: s.extrapolated(True, False), "delta": lambda s: s.extrapolated(False, False),
    "irate": lambda s: s.instant(True), "idelta": lambda s: s.instant(False),
    "changes": lambda s: s.sum(s.steps(lambda a, b: (a != b) & ~(np.isnan(a) & np.isnan(b))), 1), "resets": lambda s: s.sum(s.steps(lambda a, b: a > b), 1),
    "ts_of_first_over_time": lambda s: s.ts[s.lo] / 1000.0, "ts_of_last_over_time": lambda s: s.ts[s.hi - 1] / 1000.0,
}
NEED_TWO = {"rate", "increase", "delta", "irate", "idelta"}


def over_time(rows: DataFrame, grid: Grid, window: int, name: str) -> DataFrame:
    """(k, step_ms, value) of a function over samples (k, ts_ms, value), with a row of arrays for each series and chunk.

    Samples are dealt by series and chunk and sorted there; a task streams past them and holds one chunk.
    """
    ship(rows.sparkSession)
    start, step, last = grid.start, grid.step, (grid.last - grid.start) // grid.step
    size = max(STEPS, WINDOWS * -(-window // step))
    low, high = N.ceil_div(F.col("ts_ms") - start, step), N.floor_div(F.col("ts_ms") + (window - 1 - start), step)
    low, high = F.greatest(F.lit(0), low), F.least(F.lit(last), high)
    near = rows.where((F.col("ts_ms") > start - window) & (F.col("ts_ms") <= grid.last)).where(low <= high)
    first, then = N.floor_div(low, size), N.floor_div(high, size)  # one chunk, or two neighbours
    dealt = near.select("k", F.explode(F.when(first == then, F.array(first)).otherwise(F.array(first, then))).alias("chunk"), "ts_ms", "value")
    dealt = dealt.repartition("k", "chunk").sortWithinPartitions("k", "chunk", "ts_ms")

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def groups(some: pa.RecordBatch, whole: bool) -> pa.RecordBatch | None:
            """What the groups of a batch come to; the last stays in held unless it is whole."""
            held.clear()
            n = some.num_rows
            k, (chunk, ts, v) = some.column(0), (some.column(j).to_numpy() for j in (1, 2, 3))
            apart = pc.not_equal(k.slice(1), k.slice(0, n - 1)).to_numpy(zero_copy_only=False) | (chunk[1:] != chunk[:-1])
            bounds = np.concatenate([[0], np.flatnonzero(apart) + 1, [n]])
            if not whole:
                held.append(some.slice(int(bounds[-2])))
                bounds = bounds[:-1]
            steps, made, sizes = [np.zeros(0, np.int64)], [np.zeros(0)], [0]
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                t = start + step * np.arange(chunk[a] * size, min((chunk[a] + 1) * size, last + 1))
                lo, hi = np.searchsorted(ts[a:b], t - window, "right"), np.searchsorted(ts[a:b], t, "right")
                used = hi - lo > (name in NEED_TWO)
                with np.errstate(all="ignore"):
                    made.append(FUNCTIONS[name](Slice(ts[a:b], v[a:b], lo[used], hi[used], t[used], window)))
                steps.append(t[used])
                sizes.append(sizes[-1] + len(made[-1]))
            if len(bounds) < 2:
                return None
            offsets = pa.array(sizes, pa.int32())
            return pa.RecordBatch.from_arrays([k.take(pa.array(bounds[:-1])), *(pa.ListArray.from_arrays(offsets, np.concatenate(x)) for x in (steps, made))], ["k", "step_ms", "value"])

        for batch in batches:
            if batch.num_rows and (out := groups(pa.concat_batches([*held, batch]), False)):
                yield out
        if held:
            yield groups(held[0], True)

    return dealt.mapInArrow(reduce, f"k {dict(rows.dtypes)['k']}, step_ms array<long>, value array<double>")
