"""Benchmark decontamination by greedy string tiling.

Words (runs of letters and digits, lower-cased; other ASCII separates) of benchmark items and documents
share seeds of ``LEAST`` words, found by a hash join: the seeds of the benchmark, in slices of checked size,
stand on every executor, and documents stream past them. For each item that shares a seed with a document
the longest common runs of words that don't overlap earlier ones are marked as tiles, longest first (Wise's
running Karp-Rabin matching: rolling hashes find all runs of LEAST words or more). The share of an item's
words under tiles is its coverage in the document; reordered passages are covered as well as whole ones.
A document with an item of coverage ``COVERED`` or more is contaminated.

The benchmark may have any size: it is read in slices of ``SLICE`` bytes of text, each of which is one pass.

Where seeds repeat so often that all pairs of equal ones would be more than ``PAIRS``, the longest free run is
searched by its length instead (``longest_first``); the tiles are the same and memory stays that of the text.

Edge cases: an item with fewer than LEAST words is covered by a document of just these words (inside other text
they are ordinary words); items without words match nothing; null texts are empty; repeated items count once by
item_id and text; an empty benchmark or table finds nothing; other columns are kept by ``clean`` and ignored by
``leaks``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from .common import Words, grams, portions

LEAST = 5
COVERED = 0.5
SLICE = 16 << 20
#: Pairs of equal seeds of one text and all items that are held at once.
PAIRS = 1 << 20

ASIDE = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


class Items:
    """Seeds of some benchmark items with their places."""

    def __init__(self, ids: list[int], texts: list[bytes]):
        words = Words(texts, separates=ASIDE)
        self.ids, self.words = ids, [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        seeds = [grams(w, LEAST) for w in self.words]
        owner = np.repeat(np.arange(len(ids)), [len(s) for s in seeds])
        place = np.concatenate([np.arange(len(s)) for s in seeds] or [np.zeros(0, np.int64)])
        every = np.concatenate(seeds or [np.zeros(0, np.uint64)])
        self.short: dict[tuple[int, int], list[int]] = {}
        for k, w in enumerate(self.words):
            if 0 < len(w) < LEAST:
                self.short.setdefault((len(w), int(grams(w, len(w))[0])), []).append(k)
        order = np.argsort(every, kind="stable")
        self.seeds, self.owner, self.place = every[order], owner[order], place[order]


def tiles(i: np.ndarray, j: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, place in item, place in document), given all places (i, j) of equal seeds."""
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(i))) + least - 1
    heap = [(-n, a, b) for n, a, b in zip(size.tolist(), i[first].tolist(), j[first].tolist(), strict=True)]
    heapq.heapify(heap)
    item, doc, out = set(), set(), []
    while heap:
        n, a, b = heapq.heappop(heap)
        free = [k for k in range(-n) if a + k not in item and b + k not in doc]
        if len(free) == -n:
            out.append((-n, a, b))
            item.update(range(a, a - n))
            doc.update(range(b, b - n))
            continue
        at = 0
        while at < len(free):  # what earlier tiles leave of it
            end = at
            while end + 1 < len(free) and free[end + 1] == free[end] + 1:
                end += 1
            if end - at + 1 >= least:
                heapq.heappush(heap, (at - end - 1, a + free[at], b + free[at]))
            at = end + 1
    return out


def longest_first(item: np.ndarray, doc: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """The tiles of ``tiles`` from the words alone: each turn finds the longest run that is free on both sides."""
    free = [np.ones(len(item), bool), np.ones(len(doc), bool)]
    out, most = [], len(item)

    def places(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Where a free run of n words begins, and its hash."""
        both = []
        for words, open_ in zip((item, doc), free, strict=True):
            sums = np.concatenate([[0], np.cumsum(open_)])
            at = np.flatnonzero(sums[n:] - sums[:-n] == n) if len(words) >= n else np.zeros(0, np.int64)
            both.append((at, grams(words, n)[at]))
        return both

    while True:
        lo, hi, hit = least - 1, min(most, len(doc)), None  # a run of n words holds one of n - 1
        while lo < hi:
            n = (lo + hi + 1) // 2
            (i, x), (j, y) = places(n)
            same = np.isin(x, y)
            if same.any():
                a = int(i[same][0])
                lo, hit = n, (n, a, int(j[y == x[same][0]][0]))
            else:
                hi = n - 1
        if hit is None:
            return out
        n, a, b = hit
        out.append(hit)
        free[0][a : a + n] = False
        free[1][b : b + n] = False
        most = n


def found(items: Items, texts: list[bytes], covered: float) -> Iterator[tuple[int, int, float, int, int]]:
    """(text, item_id, coverage, tiles, longest tile) for each text and item that share a seed."""
    words = Words(texts, separates=ASIDE)
    if items.short:
        size = np.diff(words.first)
        for t in np.flatnonzero((size > 0) & (size < LEAST)).tolist():
            own = words.hash[words.first[t] : words.first[t + 1]]
            for k in items.short.get((len(own), int(grams(own, len(own))[0])), ()):
                yield t, items.ids[k], 1.0, 1, len(own)
    if not len(items.seeds):
        return
    every = grams(words.hash, LEAST)
    lo = np.searchsorted(items.seeds, every)
    hit = np.flatnonzero(items.seeds[np.minimum(lo, len(items.seeds) - 1)] == every)
    text = np.searchsorted(words.first, hit, "right") - 1
    inside = hit + LEAST <= words.first[text + 1]
    hit, text = hit[inside], text[inside]
    if not len(hit):
        return
    hi = np.searchsorted(items.seeds, every[hit], "right")
    n = hi - lo[hit]
    per = np.bincount(text, n, len(texts))
    if per.max() > PAIRS:
        for t in np.flatnonzero(per > PAIRS).tolist():
            own = words.hash[words.first[t] : words.first[t + 1]]
            ranges = np.unique(np.stack([lo[hit][text == t], hi[text == t]], 1), axis=0)
            for k in sorted({int(o) for a, b in ranges for o in items.owner[a:b]}):
                made = longest_first(items.words[k], own)
                yield t, items.ids[k], sum(x[0] for x in made) / len(items.words[k]), len(made), max(x[0] for x in made)
        few = per[text] <= PAIRS
        hit, text, n = hit[few], text[few], n[few]
        if not len(hit):
            return
    at = np.repeat(lo[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    text, j, owner, i = np.repeat(text, n), np.repeat(hit, n), items.owner[at], items.place[at]
    order = np.lexsort((owner, text))
    text, j, owner, i = text[order], j[order], owner[order], i[order]
    cuts = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (owner[1:] != owner[:-1])]))
    for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True):
        size = len(items.words[owner[a]])
        if len(np.unique(i[a:b])) * LEAST < covered * size:  # even apart these seeds cover too little
            continue
        made = tiles(i[a:b], j[a:b])
        yield int(text[a]), items.ids[owner[a]], sum(t[0] for t in made) / size, len(made), max(t[0] for t in made)


def _slices(bench: DataFrame) -> Iterator[Items]:
    """The benchmark, streamed to the driver a partition at a time, in slices."""
    ids, texts, size = [], [], 0
    for r in bench.where("text is not null").select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        ids.append(r["item_id"])
        texts.append(r["text"].encode())
        size += len(texts[-1])
        if size >= SLICE:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Items(ids, texts)


def leaks(docs: DataFrame, bench: DataFrame, covered: float = COVERED) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest) of each contaminated document and item."""
    spark: SparkSession = docs.sparkSession
    ship(spark)
    schema = "doc_id long, item_id long, coverage double, n_tiles int, longest int"
    out = spark.createDataFrame([], schema)
    for items in _slices(bench):
        sent = spark.sparkContext.broadcast(items)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch, texts in portions(batches):
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[k], *r) for k, *r in found(sent.value, texts, covered) if r[1] >= covered]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "item_id", "coverage", "n_tiles", "longest"])

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(search, schema))
    return out


def clean(docs: DataFrame, bench: DataFrame, covered: float = COVERED) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns; nothing is shuffled."""
    spark = docs.sparkSession
    ship(spark)
    for items in _slices(bench):
        sent = spark.sparkContext.broadcast(items)

        def sift(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch, texts in portions(batches):
                keep = np.ones(len(texts), bool)
                keep[[k for k, _, c, _, _ in found(sent.value, texts, covered) if c >= covered]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(sift, docs.schema)
    return docs
