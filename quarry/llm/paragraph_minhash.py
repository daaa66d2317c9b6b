"""Paragraph deduplication by MinHash banding, then of runs of words that no paragraph's bounds show.

A text's paragraphs are its lines; a line of more than ``LONG`` words is cut further at sentence ends that its
words choose (by hash), so that a passage gets the same cuts wherever it stands. Lines of ``MIN_WORDS`` or more
words take part, and of long lines pieces of ``MIN_PIECE`` or more. Equal ones (lower-cased words) are one class, whatever their number. Classes are
sets of distinct 5-word shingles; bands of MinHash values, tuned for the recall asked for, propose pairs of
classes (stars, see ``star_join``); whole sets verify them; components of links are clusters. The first
paragraph of a cluster (by doc_id, then place) stays, all others are removed.

What is left is read once more as runs of ``RUN`` words that start at anchors, with no regard to lines or
sentences. A word is an anchor if the ``SHINGLE`` words from it have the least hash of ``GAP`` neighbours
(winnowing), so a passage has the same anchors wherever it stands, and one of 2 * GAP + RUN - 2 words (50) holds
a whole run. Of equal runs (lower-cased words) the first stays, all others are removed.

A class with fewer shingles than a link between different sets needs, at one shingle apart, is joined by
equality only: banding could not link it.

Edge cases: null text has no paragraphs; rows with equal doc_id and text repeat each other and rank by
place; null doc_ids rank first; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, Words, Workspace, cut, grams, merge, mix, named, portions, restrict, signed, span_array, spans_by_row, star_links

LONG = 60
MIN_WORDS = 5
MIN_PIECE = 8
SHINGLE = 5
RUN = 20
GAP = 16
PERCENT = 80
#: Shingles of a centre's followers that one block holds.
BLOCK = 1 << 17


def tune(threshold: float = PERCENT / 100, recall: float = 0.995, most: int = 64) -> tuple[int, int]:
    """(bands, rows): the most rows a band whose bands, within ``most`` hashes in all, give the recall at the threshold."""
    for rows in range(16, 0, -1):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        if bands * rows <= most:
            return bands, rows
    return most, 1


BANDS, ROWS = tune()
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=U) * U(0xA0761D6478BD642F)) | U(1)


def paragraphs(texts: list[bytes]) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """The words of the texts, and of each paragraph that takes part its text, first word and word after the last."""
    words = Words(texts)
    data, n = words.data, len(words)
    if not n:
        z = np.zeros(0, np.int64)
        return words, z, z, z
    text = np.searchsorted(words.first, np.arange(n), "right") - 1
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    new = np.ones(n, bool)
    new[1:] = (lines[words.starts[1:]] != lines[words.starts[:-1]]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    long = np.repeat(size > LONG, size)
    last = data[words.ends - 1]
    stop = np.isin(last, np.frombuffer(b".!?", np.uint8)) & (words.hash % U(2) == 0)
    new[1:] |= long[1:] & stop[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], n)
    enough = last - first >= np.where(long[first], MIN_PIECE, MIN_WORDS)
    first, last = first[enough], last[enough]
    return words, text[first], first, last


def anchored(words: Words, text: np.ndarray, stretch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of the runs of RUN words at anchors, and a hash of each. text and stretch: numbers for each word; a run keeps to one stretch."""
    n = len(words) - RUN + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, U)
    every = grams(words.hash, SHINGLE)
    here = np.arange(len(every)) + (text[: len(every)] + 1) * (GAP - 1)  # so far apart, no text sees another one's hashes
    apart = np.full(here[-1] + GAP, ~U(0))
    inside = text[: len(every)] == text[SHINGLE - 1 :]
    apart[here[inside]] = every[inside]
    best, least = apart[GAP - 1 :].copy(), np.arange(GAP - 1, len(apart))
    for k in range(1, GAP):  # the last of equal ones
        other = apart[GAP - 1 - k : len(apart) - k]
        less = other < best
        best[less] = other[less]
        least[less] = np.flatnonzero(less) + GAP - 1 - k
    chosen = np.zeros(len(apart), bool)
    chosen[least] = True
    at = np.flatnonzero(chosen[here] & inside)
    at = at[at < n]
    at = at[stretch[at] == stretch[at + RUN - 1]]
    return at, _uids(words, at, at + RUN)


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """Band keys of each set (BANDS columns)."""
    x = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    keys = np.zeros((len(sets), BANDS), U)
    with np.errstate(over="ignore"):
        for k in range(BANDS * ROWS):
            h = x * _SEEDS[k]
            h ^= h >> U(32)
            low = np.minimum.reduceat(h * _SEEDS[-1 - k], at)
            keys[:, k // ROWS] = mix(keys[:, k // ROWS] + low + U(k))
    return keys


def joining(block: np.ndarray, ids: np.ndarray, component: np.ndarray, sets: list[np.ndarray], across: bool) -> np.ndarray:
    """Links (smaller id, larger id) that join the components of the sets as all links would (across: of two blocks)."""
    size = np.array([len(x) for x in sets])
    value, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    first = np.flatnonzero(np.diff(value, prepend=value[:1] + U(1)))
    much = np.diff(np.append(first, len(value)))
    rank = np.empty(len(value), np.int64)
    rank[order] = np.repeat(np.arange(len(first)), much)
    component, at, out = component.copy(), 0, []
    for k, n in enumerate(size.tolist()):
        r = rank[at : at + n]
        at += n
        r = r[much[r] > 1]
        m = much[r]
        shared = np.bincount(owner[np.repeat(first[r] - (np.cumsum(m) - m), m) + np.arange(m.sum())], minlength=len(sets))
        near = (100 * shared >= PERCENT * (n + size - shared)) & (component != component[k])
        if across:
            near &= block != block[k]
        for j in np.flatnonzero(near).tolist():
            if component[j] != component[k]:
                out.append((min(ids[j], ids[k]), max(ids[j], ids[k])))
                component[component == component[j]] = component[k]
    return np.array(out, np.int64).reshape(-1, 2)


def _linked(inter: int, a: int, b: int) -> bool:
    return 100 * inter >= PERCENT * (a + b - inter)


class ParagraphDedup:
    def __init__(self, docs: DataFrame):
        self.docs, self.ws = docs, Workspace(docs.sparkSession)

    def _units(self) -> DataFrame:
        """(rid, tie, place, a, b, uid, n): every paragraph that takes part; a, b: its bytes; n: its shingles at most."""

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in portions(batches, most=1 << 19):
                words, text, first, last = paragraphs(texts)
                if not len(text):
                    continue
                uid = _uids(words, first, last)
                rid, tie = (batch.column(k).to_numpy()[text] for k in ("rid", "tie"))
                a, b = words.starts[first] - words.begins[text], words.ends[last - 1] - words.begins[text]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid), pa.array(tie), pa.array((first - words.first[text]).astype(np.int32)), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(uid.view(np.int64)), pa.array((last - first - SHINGLE + 1).astype(np.int32))],
                    ["rid", "tie", "place", "a", "b", "uid", "n"],
                )

        return named(self.docs).select("rid", "tie", "text").mapInArrow(read, "rid long, tie long, place int, a int, b int, uid long, n int")

    def _sets(self, ids: DataFrame | None, of: DataFrame, out: str) -> DataFrame:
        """Of classes (all that can have links, or ids): band keys (``records``) or whole sets (``shingles``), from their first text."""
        least = 1  # shingles: the fewest for which one more or less is still a link
        while not _linked(least, least, least + 1):
            least += 1
        firsts = of if ids is None else restrict(of, ids.select(F.col("id").alias("uid")), "uid")
        firsts = firsts.where(F.col("n") >= least)
        per = firsts.groupBy("rid", "tie").agg(F.collect_list("uid").alias("uids"))
        rows = named(self.docs)
        rows = rows.join(per, ["rid", "tie"]).select("text", "uids") if ids is None else restrict(rows, self.ws.keep(per.select("rid", "tie"), f"texts-{out}-{self._turn()}"), ["rid", "tie"]).join(per, ["rid", "tie"]).select("text", "uids")

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in portions(batches, most=1 << 19):
                words, text, first, last = paragraphs(texts)
                uid = _uids(words, first, last).view(np.int64)
                wanted, seen = [set(u) for u in batch.column("uids").to_pylist()], set()
                every = grams(words.hash, SHINGLE)
                ids_, sets = [], []
                for t, u, a, b in zip(text.tolist(), uid.tolist(), first.tolist(), last.tolist(), strict=True):
                    if u in wanted[t] and u not in seen:
                        seen.add(u)
                        ids_.append(u)
                        sets.append(np.unique(every[a : b - SHINGLE + 1]))
                if not ids_:
                    continue
                if out == "records":
                    keys = minhash(sets)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(np.array(ids_, np.int64), BANDS)), pa.array(np.zeros(keys.size, np.int64))], ["key", "id", "whole"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(ids_, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "shingles"])

        return rows.mapInArrow(read, "key long, id long, whole long" if out == "records" else "id long, shingles binary")

    def _turn(self) -> int:
        self._turns = getattr(self, "_turns", 0) + 1
        return self._turns

    def _verify(self, pairs: DataFrame, name: str) -> DataFrame:
        ws = self.ws
        ids = ws.keep(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), f"{name}-ids")
        sets = ws.keep(self._sets(ids, self.firsts, "shingles"), f"{name}-sets")
        left, right = (sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sa, sb = ([np.frombuffer(x, U) for x in batch.column(k).to_pylist()] for k in ("sa", "sb"))
                keep = [_linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)) for x, y in zip(sa, sb, strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        links = ws.keep(pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb").mapInArrow(exact, "a long, b long").distinct(), f"{name}-links")
        ws.drop(f"{name}-ids", f"{name}-sets")
        return links

    def _arms(self, members: DataFrame) -> DataFrame:
        """Links among what follows an open centre: enough to join what links join, found on whole sets inside the task.

        A centre's sets are dealt out in blocks of about ``BLOCK`` shingles, and each pair of blocks is a group.
        """
        ws = self.ws
        ids = ws.keep(members.select(F.col("b").alias("id")).distinct(), "arm-ids")
        sets = ws.keep(self._sets(ids, self.firsts, "shingles"), "arm-sets")
        sized = members.join(self.firsts.select(F.col("uid").alias("b"), "n"), "b")
        per = sized.groupBy("a").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
        rows = members.join(per.select("a", "blocks"), "a").withColumn("i", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
        rows = rows.select("a", "b", "component", "i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
        rows = rows.select("a", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "b", "component").join(sets.select(F.col("id").alias("b"), "shingles"), "b")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            group, held = None, []

            def flush() -> pa.RecordBatch:
                links = joining(*(np.array(c) for c in list(zip(*held, strict=True))[:3]), [x[3] for x in held], group[1] != group[2])
                return pa.RecordBatch.from_arrays([pa.array(links[:, k]) for k in range(2)], ["a", "b"])

            for batch in batches:
                for a, lo, hi, *row, s in zip(*(batch.column(k).to_pylist() for k in ("a", "lo", "hi", "i", "b", "component", "shingles")), strict=True):
                    if group != (a, lo, hi):
                        if held:
                            yield flush()
                        group, held = (a, lo, hi), []
                    held.append((*row, np.frombuffer(s, U)))
            if held:
                yield flush()

        found = rows.repartition("a", "lo", "hi").sortWithinPartitions("a", "lo", "hi", "b").mapInArrow(compare, "a long, b long").distinct()
        links = ws.keep(found, "arm-links")
        ws.drop("arm-ids", "arm-sets")
        return links

    def clusters(self) -> tuple[DataFrame, DataFrame]:
        """All paragraphs, and (uid, cluster, first place) of classes with more than one paragraph in their cluster."""
        ws = self.ws
        units = ws.keep(self._units(), "units")
        place = F.struct("rid", "tie", "place")
        classes = ws.keep(units.groupBy("uid").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.max("n").alias("size")), "classes")
        self.firsts = classes.select("uid", F.col("size").alias("n"), "first.rid", "first.tie")
        component = star_links(ws, self._sets(None, self.firsts, "records"), self._verify, self._arms)
        joined = classes.join(component.select(F.col("id").alias("uid"), "component"), "uid", "left").withColumn("cluster", F.coalesce("component", "uid"))
        linked = joined.where("component is not null")
        first = linked.groupBy("cluster").agg(F.min("first").alias("first"))
        many = linked.select("uid", "cluster").join(first, "cluster").select("uid", "cluster", "first")
        alone = joined.where("component is null and n > 1").select("uid", "cluster", "first")
        return units, ws.keep(many.unionByName(alone), "clusters")

    def removals(self) -> DataFrame:
        """(rid, tie, a, b, gone) of each paragraph that repeats; gone: not the first of its cluster."""
        units, clusters = self.clusters()
        here = F.struct("rid", "tie", "place")
        return units.join(clusters, "uid").select("rid", "tie", "a", "b", (here != F.col("first")).alias("gone"))

    def _runs(self, removed: DataFrame) -> DataFrame:
        """(rid, tie, place, a, b, uid): every anchored run of words that keeps clear of the spans removed (a, b)."""
        rows = spans_by_row(self.ws, self.docs, removed)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in portions(batches, most=1 << 17):
                words = Words(texts)
                text = np.searchsorted(words.first, np.arange(len(words)), "right") - 1
                spans = [merge(span_array(x)) + t for x, t in zip(batch.column("spans").to_pylist(), words.begins.tolist(), strict=False)]
                spans = np.concatenate([*spans, np.zeros((0, 2), np.int64)])
                begun, over = (np.searchsorted(spans[:, k], words.starts, "right") for k in range(2))
                # words in a span are alone in their stretch, others share it up to the next span or text
                new = np.diff(text, prepend=-1) | np.diff(begun, prepend=0) | (begun > over) | np.diff(over, prepend=0)
                at, uid = anchored(words, text, np.cumsum(new != 0))
                if not len(at):
                    continue
                text, a, b = text[at], words.starts[at], words.ends[at + RUN - 1]
                rid, tie = (batch.column(k).to_numpy()[text] for k in ("rid", "tie"))
                place, a, b = (pa.array(x.astype(np.int32)) for x in (at - words.first[text], a - words.begins[text], b - words.begins[text]))
                yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(tie), place, a, b, signed(uid)], ["rid", "tie", "place", "a", "b", "uid"])

        return rows.select("rid", "tie", "text", "spans").mapInArrow(read, "rid long, tie long, place int, a int, b int, uid long")

    def repeats(self, removed: DataFrame) -> DataFrame:
        """(rid, tie, a, b, gone) of each run of words that is left and repeats; gone: not the first of its kind."""
        runs = self.ws.keep(self._runs(removed), "runs")
        here = F.struct("rid", "tie", "place")
        many = runs.groupBy("uid").agg(F.min(here).alias("first"), F.count("*").alias("n")).where("n > 1")
        many = self.ws.keep(many.select("uid", "first"), "repeated-runs")
        return restrict(runs, many.select("uid"), "uid").join(many, "uid").select("rid", "tie", "a", "b", (here != F.col("first")).alias("gone"))

    def rows(self) -> DataFrame:
        """Documents with a repeated paragraph or run: doc_id, n_repeated, n_removed (of both), removed_bytes, kept_sha256, kept."""
        found = self.ws.keep(self.removals(), "removals")
        found = found.unionByName(self.ws.keep(self.repeats(found.where("gone").select("rid", "tie", "a", "b")), "repeats"))
        counts = found.groupBy("rid", "tie").agg(F.count("*").alias("n_repeated"), F.sum(F.col("gone").cast("long")).alias("n_removed"))
        per = found.where("gone").groupBy("rid", "tie").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
        both = self.ws.keep(counts.join(per, ["rid", "tie"], "left"), "by-row")
        rows = restrict(named(self.docs), both.select("rid", "tie"), ["rid", "tie"]).join(both, ["rid", "tie"]).select("doc_id", "text", "n_repeated", "n_removed", "spans")

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in portions(batches, most=1 << 19):
                spans = [merge(span_array(x)) for x in batch.column("spans").to_pylist()]
                kept = [cut(t, s) for t, s in zip(texts, spans, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()), batch.column("n_repeated"), batch.column("n_removed"), pa.array([len(t) - len(k) for t, k in zip(texts, kept, strict=True)], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(kept, pa.binary())],
                    ["doc_id", "n_repeated", "n_removed", "removed_bytes", "kept_sha256", "kept"],
                )

        return rows.mapInArrow(apply, "doc_id long, n_repeated long, n_removed long, removed_bytes long, kept_sha256 string, kept binary")


def _uids(words: Words, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of each paragraph's word sequence."""
    if not len(first):
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        n = last - first
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(first, n) + inner
        return mix(np.add.reduceat(mix(words.hash[at] + inner.astype(U) * U(0x9E3779B97F4A7C15)), np.cumsum(n) - n) + n.astype(U))
