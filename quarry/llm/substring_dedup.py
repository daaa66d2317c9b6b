"""Removal of repeated substrings with run-length compressed Burrows-Wheeler indexes.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else (in the same text or
another). Strings are judged on the input; matches never cross texts.

1. Winnowing picks anchors: in every window of ``length`` bytes the smallest hash of ``GRAM`` bytes, so equal
   windows have an anchor at the same place. An anchor's segment is all bytes a window with it can have.
2. Rows of hashes (anchor, segment) are sorted by hash; those of anchors with more than ``HOT`` rows never meet in a
   task but are counted by segment. Anchors seen once end here. Segments that are equal
   are repeated as a whole. What is left are different segments of one anchor: where repeats begin or end.
3. Their bytes are indexed in blocks of whole anchor groups: the suffix array gives the Burrows-Wheeler
   transform, which is run-compressed; matches are computed at the sampled ends of runs only, and the
   statistics of all other positions follow in one stream over the text (inside a run the match of
   position i + 1 is that of i less one). A position whose match reaches ``length`` starts a repeat.
4. An anchor with more different segments than ``GROUP`` is not indexed in one task: its windows are hashed
   one by one and counted, which is exact as well and spreads over all tasks.

Edge cases: null text is empty; texts shorter than ``length`` have no repeats; repeated rows repeat each
other; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, Workspace, cut, merge, named, portions, restrict, rolling, runs, signed, span_array, spans_by_row

GRAM = 64
GROUP = 16_384
#: Rows of an anchor that one task takes; anchors of more are counted by segment first.
HOT = 50_000
#: Rows of counts that are sent to every executor at most, of 33 bytes each.
SENT = 500_000
BLOCK = 1 << 20


def anchors(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Places of the anchors of texts data[begins[i]:ends[i]]."""
    long = ends - begins >= length
    if not long.any():
        return np.zeros(0, np.int64)
    n = len(data) - GRAM + 1
    h = rolling(data)(np.arange(n), np.arange(GRAM, GRAM + n))
    key = (h & U(0xFFFFFFFF00000000)) | np.arange(n, dtype=U)
    run, have, width = key, 1, length - GRAM + 1
    while have < width:
        step = min(have, width - have)
        run, have = np.minimum(run[:-step], run[step:]), have + step
    ok = np.zeros(len(run) + 1, np.int32)
    np.add.at(ok, begins[long], 1)
    np.add.at(ok, ends[long] - length + 1, -1)
    return np.unique((run[np.cumsum(ok[:-1]) > 0] & U(0xFFFFFFFF)).astype(np.int64))


def suffix_array(t: np.ndarray, group: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of (group, the bytes to the piece's end); equal ones in text order, as if every
    piece had an end mark of its own. left: bytes to the end of a position's piece. Prefix doubling from 4 bytes."""
    n = len(t)
    key = group.astype(U)
    for k in range(4):
        key = key << U(8) | np.where(left > k, np.concatenate([t[k:], t[:k]]), 0).astype(U)
    have = 4
    while True:
        order = np.argsort(key)
        s = key[order]
        new = np.concatenate([[False], s[1:] != s[:-1]])
        rank = np.empty(n, U)
        rank[order] = np.cumsum(new).astype(U)
        if int(new.sum()) == n - 1:
            return order
        if have >= depth:
            return np.argsort(rank << U(32) | np.arange(n, dtype=U))
        after = np.zeros(n, U)
        after[:-have] = np.where(left[:-have] > have, rank[have:] + U(1), U(0))
        key, have = rank << U(32) | after, 2 * have


def common_prefix(t: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of suffixes i and j."""
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate([t, np.full(8, 0, np.uint8)]), 8)
    out, live = np.zeros(len(i), np.int64), np.arange(len(i))
    n = len(t)
    while len(live):
        a, b = i[live] + out[live], j[live] + out[live]
        inside = (a < n) & (b < n)
        live, a, b = live[inside], a[inside], b[inside]
        same = np.cumprod(words[a] == words[b], axis=1, dtype=np.uint8).sum(1, dtype=np.int64)
        out[live] += same
        live = live[same == 8]
    return np.minimum(out, n - np.maximum(i, j))


def repeated(pieces: list[bytes], groups: list[int], length: int) -> list[np.ndarray]:
    """For each piece the places where a string of ``length`` bytes begins that also begins elsewhere in its group.

    Pieces hold no byte 255.
    """
    t = np.frombuffer(b"".join(p + b"\xff" for p in pieces), np.uint8)
    sizes = np.array([len(p) + 1 for p in pieces])
    ends = np.cumsum(sizes)
    n = len(t)
    left = np.repeat(ends, sizes) - np.arange(n)
    sa = suffix_array(t, np.repeat(np.array(groups), sizes), left, int(sizes.max()))
    bwt = np.where(sa > 0, t[sa - 1], 255)
    # a run also ends at a piece's start: nothing stands before it
    breaks = (bwt[1:] != bwt[:-1]) | (bwt[1:] == 255)
    heads = np.flatnonzero(breaks) + 1
    match = np.zeros(n, np.int64)
    for own, other in ((heads, heads - 1), (heads - 1, heads)):  # sampled at the first and at the last of each run
        lengths = common_prefix(t, sa[own], sa[other])
        reach = np.full(n, -1, np.int64)
        reach[sa[own]] = sa[own] + lengths
        known = reach >= 0
        edge = sa[0] if own is heads else sa[-1]
        if not known[edge]:
            reach[edge], known[edge] = edge, True
        known[0], reach[0] = True, max(reach[0], 0)
        at = np.maximum.accumulate(np.where(known, np.arange(n), 0))
        match = np.maximum(match, reach[at] - np.arange(n))
    good = np.minimum(match, left - 1) >= length
    return [np.flatnonzero(good[e - s : e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


class SubstringDedup:
    """``spans()`` gives (rid, tie, a, b) of repeats; ``rows()`` the kept bytes of each row of docs."""

    def __init__(self, docs: DataFrame, length: int = 200):
        if length <= GRAM:
            raise ValueError(f"length must be over {GRAM}")
        self.docs, self.length, self.ws = docs, length, Workspace(docs.sparkSession)

    def _anchors(self) -> DataFrame:
        length = self.length

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in portions(batches):
                sizes = np.array([len(t) for t in texts], np.int64)
                ends = np.cumsum(sizes)
                begins = ends - sizes
                data = np.frombuffer(b"".join(texts), np.uint8)
                at = anchors(data, begins, ends, length)
                row = np.searchsorted(ends, at, "right")
                a, b = np.maximum(begins[row], at - (length - GRAM)), np.minimum(ends[row], at + length)
                h = rolling(data)
                rid, tie = (batch.column(k).to_numpy()[row] for k in ("rid", "tie"))
                yield pa.RecordBatch.from_arrays(
                    [signed(h(at, at + GRAM)), signed(h(a, b) ^ (at - a).astype(U)), pa.array(rid), pa.array(tie), pa.array((a - begins[row]).astype(np.int32)), pa.array((b - begins[row]).astype(np.int32))],
                    ["h", "segment", "rid", "tie", "a", "b"],
                )

        return named(self.docs).select("rid", "tie", "text").mapInArrow(pick, "h long, segment long, rid long, tie long, a int, b int")

    def _sift(self) -> DataFrame:
        """Rows of anchors seen twice: whole segments that repeat (kind 0), segments to compare (1), those beyond GROUP (2)."""

        def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["h", "segment", "rid", "tie", "a", "b"]
            held: list[np.ndarray] | None = None
            nth, last = 0, None  # the segment's number within its anchor, and the row before those held

            def judge(x: list[np.ndarray], n: int) -> pa.RecordBatch:
                nonlocal nth, last
                h, s = x[0], x[1]
                size = len(h)
                new_h = runs(h, last and last[0])
                new_s = new_h | runs(s, last and last[1])
                at = np.maximum.accumulate(np.where(new_h, np.arange(size), -1))
                count = np.cumsum(new_s)
                number = np.where(at >= 0, count - count[at], nth + count)
                ends_s, ends_h = np.append(new_s[1:], True), np.append(new_h[1:], True)
                whole = ~new_s | ~ends_s
                compare = ends_s & ((number > 0) | ~ends_h)
                whole[n:] = compare[n:] = False
                nth, last = int(number[n - 1]), (h[n - 1], s[n - 1])
                i = np.concatenate([np.flatnonzero(whole), np.flatnonzero(compare)])
                kind = np.concatenate([np.zeros(whole.sum(), np.int32), np.where(number[compare] < GROUP, 1, 2).astype(np.int32)])
                return pa.RecordBatch.from_arrays([pa.array(kind), *(pa.array(x[k][i]) for k in (0, 2, 3, 4, 5))], ["kind", "h", "rid", "tie", "a", "b"])

            for batch in batches:
                x = [batch.column(k).to_numpy() for k in names]
                x = x if held is None else [np.concatenate(y) for y in zip(held, x, strict=True)]
                if len(x[0]) > 1:
                    yield judge(x, len(x[0]) - 1)
                held = [y[-1:] for y in x] if len(x[0]) else held
            if held is not None:
                yield judge(held, 1)

        ws = self.ws
        rows = ws.keep(self._anchors(), "anchors")
        hot = ws.keep(rows.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("h"), "hot-anchors")
        some = hot.limit(1).count() > 0
        dealt = (restrict(rows, hot, "h", "left_anti") if some else rows).repartition("h").sortWithinPartitions("h", "segment")
        out = dealt.mapInArrow(sift, "kind int, h long, rid long, tie long, a int, b int")
        out = ws.keep(out.unionByName(self._sift_hot(restrict(rows, hot, "h"))) if some else out, "sifted")
        ws.drop("anchors")
        return out

    def _sift_hot(self, rows: DataFrame) -> DataFrame:
        """The same for anchors of very many rows: their segments are counted before they are shuffled, and what was counted is joined to the rows."""
        ws = self.ws
        rows = rows.withColumn("mark", F.xxhash64("rid", "tie", "a", "b"))
        per = ws.keep(rows.groupBy("h", "segment").agg(F.count("*").alias("n"), F.min("mark").alias("first")), "hot-segments")
        of = ws.keep(per.groupBy("h").agg(F.count("*").alias("segments")), "hot-sizes")
        kind = F.when(F.col("segments") > 1, F.when(F.col("segments") <= GROUP, 1).otherwise(2))
        kinds = per.join(F.broadcast(of) if of.count() <= SENT else of, "h").select("h", "segment", "first", (F.col("n") > 1).alias("whole"), kind.alias("compare"))
        kinds = ws.keep(kinds.where("whole or compare is not null"), "hot-kinds")
        joined = rows.join(F.broadcast(kinds) if kinds.count() <= SENT else kinds, ["h", "segment"])
        each = F.array_compact(F.array(F.when(F.col("whole"), 0), F.when(F.col("mark") == F.col("first"), F.col("compare"))))
        return joined.select(F.explode(each).alias("kind"), "h", "rid", "tie", "a", "b")

    def _segments(self, wanted: DataFrame) -> DataFrame:
        """wanted (h, rid, tie, a, b) with the bytes."""
        per = self.ws.keep(wanted.groupBy("rid", "tie").agg(F.collect_list(F.struct("h", "a", "b")).alias("of")), "wanted")
        rows = restrict(named(self.docs), per.select("rid", "tie"), ["rid", "tie"]).join(per, ["rid", "tie"]).select("rid", "tie", "text", "of")

        def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in portions(batches, most=1 << 19):
                out = [(o["h"], rid, tie, o["a"], t[o["a"] : o["b"]]) for rid, tie, t, of in zip(batch.column("rid").to_pylist(), batch.column("tie").to_pylist(), texts, batch.column("of").to_pylist(), strict=True) for o in of]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["h", "rid", "tie", "a", "bytes"])

        return rows.mapInArrow(take, "h long, rid long, tie long, a int, bytes binary")

    def _indexed(self, segments: DataFrame) -> DataFrame:
        length = self.length

        def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block: list[tuple[int, int, int, int, bytes]] = []  # of whole groups, but for the last
            size = 0

            def solve(rows: list[tuple[int, int, int, int, bytes]]) -> pa.RecordBatch:
                pieces: list[list] = []
                for h, rid, tie, a, x in rows:  # sorted; what overlaps in one text is one piece
                    p = pieces[-1] if pieces else None
                    if p and p[:3] == [h, rid, tie] and a <= p[3] + len(p[4]):
                        p[4] += x[max(0, p[3] + len(p[4]) - a) :]
                    else:
                        pieces.append([h, rid, tie, a, x])
                number = np.cumsum(np.array([0] + [int(x[0] != y[0]) for x, y in zip(pieces[1:], pieces[:-1], strict=True)]))
                starts = repeated([p[4] for p in pieces], number.tolist(), length)
                out = [[], [], [], []]
                for p, s in zip(pieces, starts, strict=True):
                    for a, b in merge(np.stack([s, s + length], 1)).tolist():
                        for column, v in zip(out, (p[1], p[2], p[3] + a, p[3] + b), strict=True):
                            column.append(v)
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["rid", "tie", "a", "b"])

            for batch in batches:
                for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if size >= BLOCK and r[0] != block[-1][0]:
                        yield solve(block)
                        block, size = [], 0
                    block.append(r)
                    size += len(r[4])
            if block:
                yield solve(block)

        dealt = segments.repartition("h").sortWithinPartitions("h", "rid", "tie", "a")
        return dealt.mapInArrow(index, "rid long, tie long, a int, b int")

    def _counted(self, segments: DataFrame) -> DataFrame:
        length = self.length

        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(0, batch.num_rows, 2000):
                    part = batch.slice(k, 2000)
                    pieces = part.column("bytes").to_pylist()
                    sizes = np.array([len(p) for p in pieces])
                    n = np.maximum(0, sizes - length + 1)
                    row = np.repeat(np.arange(len(pieces)), n)
                    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    at = (np.cumsum(sizes) - sizes)[row] + inner
                    h = rolling(np.frombuffer(b"".join(pieces), np.uint8))(at, at + length)
                    rid, tie, a = (part.column(c).to_numpy()[row] for c in ("rid", "tie", "a"))
                    yield pa.RecordBatch.from_arrays([signed(h), pa.array(rid), pa.array(tie), pa.array((a + inner).astype(np.int32))], ["w", "rid", "tie", "a"])

        rows = segments.mapInArrow(windows, "w long, rid long, tie long, a int")
        places = F.struct("rid", "tie", "a")
        twice = rows.groupBy("w").agg(F.min(places).alias("lo"), F.max(places).alias("hi")).where("lo <> hi").select("w")
        return rows.join(twice, "w", "left_semi").select("rid", "tie", "a", (F.col("a") + length).alias("b"))

    def spans(self) -> DataFrame:
        ws = self.ws
        sifted = self._sift()
        hot = ws.keep(sifted.where("kind = 2").select("h").distinct(), "hot")
        compare = sifted.where("kind > 0").select("h", "rid", "tie", "a", "b")
        whole = sifted.where("kind = 0").select("rid", "tie", "a", "b")
        segments = self._segments(compare)
        if not hot.limit(1).count():
            return whole.unionByName(self._indexed(segments))
        segments = ws.keep(segments, "segments")
        few, many = (restrict(segments, hot, "h", how) for how in ("left_anti", "left_semi"))
        return whole.unionByName(self._indexed(few)).unionByName(self._counted(many))

    def rows(self, texts: bool = False) -> DataFrame:
        """doc_id, n_bytes, n_removed, n_spans, kept_sha256; with texts, also spans and the kept bytes."""
        joined = spans_by_row(self.ws, self.docs, self.spans()).select("doc_id", "text", "spans")

        def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, raw in portions(batches):
                spans = [merge(span_array(x)) for x in batch.column("spans").to_pylist()]
                kept = [cut(t, s) for t, s in zip(raw, spans, strict=True)]
                out = [
                    batch.column("doc_id").cast(pa.int64()), pa.array([len(t) for t in raw], pa.int64()), pa.array([len(t) - len(k) for t, k in zip(raw, kept, strict=True)], pa.int64()),
                    pa.array([len(s) for s in spans], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                ]
                more = [pa.array([s.ravel().tolist() for s in spans], pa.list_(pa.int64())), pa.array(kept, pa.binary())] if texts else []
                yield pa.RecordBatch.from_arrays(out + more, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"][: 5 + len(more)])

        return joined.mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<long>, kept binary" * texts)
