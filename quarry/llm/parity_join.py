"""N-gram Jaccard self-join by parity sketches.

A text is the set of its distinct n-word shingles. XOR-hashing a set into bits leaves each bit as the
parity of the shingles that fall on it, so the Hamming distance of two sketches never exceeds the size
of the symmetric difference. With similarity t a set of n shingles differs from a partner in at most
``n * (1 - t) / t`` shingles; its sketch is cut into more words (parts) than that, so one part with
shingles in it must be equal on both sides (pigeonhole). Parts are sized per band of set sizes; a set
joins in its own band and, if it can be the larger of a pair, in the band below.

Only part words (fingerprints of their wide bit patterns) are shuffled. In a group of equal words only
links to the group's smallest id are proposed (stars, never all pairs); what they leave open, and only
that, is compared in a second pass. Before an exact check of the whole sets, sketches that lie too far
apart end a candidate. Exact copies are one class from the start.

Skew: words that many sets share (counted over all sets in a table of fixed size) are left out by a set
that has enough other words for the pigeonhole; sets that haven't keep them, and those are salted.

Edge cases. Null or wordless text: ``n_shingles`` 0, linked with nothing. Null doc_id: the row is
returned with a null component and links nothing. Rows with equal doc_id are each judged
by their own text; where such an id represents several texts, their links are its links. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, U, Workspace, mix, portions, restrict, shingle_sets, signed, star_join

#: Counters for words that many sets share: memory is fixed, all words are counted.
SLOTS = 1 << 19
#: Sets of one centre that one task compares.
TOGETHER = 2048
#: Shingles of one block of a component, whose links one task counts with those to another block.
BLOCK = 1 << 19
#: Sketches of so many bytes are compared whole; longer ones are folded.
SHORT = 32
#: A counter this many times the mean is of a frequent word.
FREQUENT = 8
#: Sets of one frequent word that get a salt of their own.
SHARE = 4096
STRETCH = 1.25


@cache
def bands(percent: int) -> tuple[list[int], list[int]]:
    """The least size of each band, and its number of parts. Sizes of up to 2**40."""
    ratio, least = (100 / percent) ** 2, [1]
    while least[-1] < 1 << 40:
        least.append(max(least[-1] + 1, int(np.ceil(least[-1] * ratio))))
    return least, [int(STRETCH * ((top - 1) * (100 - percent) // percent)) + 2 for top in least[1:]]


def families(n: int, percent: int) -> list[tuple[int, int]]:
    """The bands in which a set of n joins, each with the most differences to a partner there."""
    least, _ = bands(percent)
    own = int(np.searchsorted(least, n, "right")) - 1
    out = [(own, n * (100 - percent) // percent)]
    if own and -(-n * percent // 100) < least[own]:
        out.append((own - 1, 2 * n * (100 - percent) // (100 + percent)))
    return out


def part_words(s: np.ndarray, band: int, percent: int) -> np.ndarray:
    """Fingerprints of the parts that have shingles in them."""
    m = U(bands(percent)[1][band])
    part = ((s >> U(32)) * m) >> U(32)  # s is sorted, and so are its parts
    first = np.flatnonzero(np.diff(part, prepend=part[:1] + U(1)))
    with np.errstate(over="ignore"):
        return mix(np.bitwise_xor.reduceat(mix(s), first) + part[first] * U(0x9E3779B97F4A7C15) + U(band) * U(0xD6E8FEB86659FD93))


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity bits, about four for each shingle; their number is a power of two, so that halves can be folded."""
    bits = max(64, 1 << int(4 * len(s) - 1).bit_length())
    ones = np.bincount((mix(s ^ U(0x5851F42D4C957F2D)) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(ones.astype(np.uint8), bitorder="little")


def apart(x: np.ndarray, y: np.ndarray) -> int:
    """The Hamming distance of two sketches, the longer folded to the shorter."""
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def allowed(a: int, b: int, percent: int) -> int:
    """The largest symmetric difference of linked sets of these sizes."""
    return (a + b) * (100 - percent) // (100 + percent)


def linked(inter: int, a: int, b: int, percent: int) -> bool:
    return 100 * inter >= percent * (a + b - inter)


def near_arms(members: DataFrame, sets: DataFrame, percent: int, nearest: bool = False) -> DataFrame:
    """Pairs of sets (id, n, sketch) that follow one open centre, are in different components, and whose folded sketches are near.

    A centre's sets come in the order of their size and are compared with those not too small for them; no
    pair leaves the task but near ones (nearest: of those, each set's nearest). Centres with more than TOGETHER sets are dealt out as pairs of blocks.
    """
    per = members.groupBy("a").agg(F.count("*").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    per = per.select("a", F.ceil(F.col("size") / TOGETHER).cast("int").alias("blocks"))
    rows = members.join(per, "a").withColumn("i", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j")
    rows = rows.select("a", "b", "component", "i", other).select("a", "b", "component", "i", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"))
    rows = rows.join(sets.select(F.col("id").alias("b"), "n", "sketch"), "b")

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sketches of a bit or two for each shingle, or of all bits up to SHORT bytes: folding keeps the bound."""
        for batch in batches:
            out = []
            for x in batch.column("sketch").to_pylist():
                x = np.frombuffer(x, np.uint8)
                for _ in range(2):
                    if len(x) > SHORT:
                        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], batch.schema.names)

    schema = "b long, a long, component long, i int, lo int, hi int, n long, sketch binary"
    rows = rows.select("b", "a", "component", "i", "lo", "hi", "n", "sketch").mapInArrow(short, schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, {}
        for batch in batches:
            out: list[tuple[np.ndarray, np.ndarray]] = []
            for b, a, c, i, lo, hi, n, x in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if group != (a, lo, hi):
                    group, held = (a, lo, hi), {}
                x = np.frombuffer(x, U)
                size, best = len(x), []
                for k in (size, size // 2):
                    if k not in held:
                        continue
                    bits, facts, count = held[k]
                    y = x if k == size else x[:k] ^ x[k:]
                    at = int(np.searchsorted(facts[2, :count], -(-n * percent // 100)))
                    near = facts[1, at:count] != c
                    if lo != hi:
                        near &= facts[3, at:count] != i
                    near = np.flatnonzero(near) + at
                    if len(near):
                        d = np.bitwise_count(bits[near] ^ y).sum(1, dtype=np.int64)
                        close = d <= (facts[2, near] + n) * (100 - percent) // (100 + percent)
                        ids, d = facts[0, near[close]], d[close]
                        if nearest:
                            best += [(int(d.min()), int(ids[d.argmin()]))] if len(ids) else []
                        else:
                            out.append((np.minimum(ids, b), np.maximum(ids, b)))
                if best:
                    out.append((np.array([min(b, min(best)[1])]), np.array([max(b, min(best)[1])])))
                bits, facts, count = held.get(size) or (np.zeros((16, size), U), np.zeros((4, 16), np.int64), 0)
                if count == len(bits):
                    bits, facts = np.concatenate([bits, np.zeros_like(bits)]), np.concatenate([facts, np.zeros_like(facts)], 1)
                bits[count], facts[:, count] = x, (b, c, n, i)
                held[size] = (bits, facts, count + 1)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(y)) for y in zip(*out, strict=True)], ["a", "b"])

    dealt = rows.repartition("a", "lo", "hi").sortWithinPartitions("a", "lo", "hi", "n")
    return dealt.mapInArrow(compare, "a long, b long").where("a <> b").distinct()


def count_links(ids: np.ndarray, block: np.ndarray, sets: list[np.ndarray], across: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, and with how many others each is linked (across: of the other block)."""
    size = np.array([len(x) for x in sets])
    value, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    new = np.diff(value, prepend=value[:1] + U(1)) != 0
    first = np.flatnonzero(new)
    much = np.diff(np.append(first, len(value)))
    rank = np.empty(len(value), np.int64)
    rank[order] = np.cumsum(new) - 1
    distinct, of = np.unique(ids, return_inverse=True)
    found, repeats, at = np.zeros(len(distinct), np.int64), len(distinct) < len(ids), 0
    partners: dict[int, list[np.ndarray]] = {}
    for k, n in enumerate(size.tolist()):
        r = rank[at : at + n]
        at += n
        r = r[much[r] > 1]
        m = much[r]
        shared = np.bincount(owner[np.repeat(first[r] - (np.cumsum(m) - m), m) + np.arange(m.sum())], minlength=len(sets))
        near = (100 * shared >= percent * (n + size - shared)) & (ids != ids[k])
        if across:
            near &= block != block[k]
        if repeats:  # an id of several texts: each partner counts once
            partners.setdefault(of[k], []).append(of[near])
        else:
            found[of[k]] = near.sum()
    for k, x in partners.items():
        found[k] = len(np.unique(np.concatenate(x)))
    return distinct, found


class ParityJoin:
    """``classes()`` gives doc_id, n_shingles, n_links, component_id for each row of docs (doc_id, text)."""

    def __init__(self, docs: DataFrame, percent: int = 80, words: int = 5):
        self.docs, self.percent, self.n = docs.select("doc_id", "text"), percent, words
        self.ws = Workspace(docs.sparkSession)

    # sets, classes of equal sets, part words

    def _read(self) -> DataFrame:
        n, percent = self.n, self.percent

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in portions(batches):
                rows = []
                for s in shingle_sets(texts, n):
                    if not len(s):
                        rows.append((0, 0, 0, b"", b""))
                        continue
                    words, spare = [], []
                    for band, most in families(len(s), percent):
                        w = part_words(s, band, percent)
                        if len(w) <= most:  # too few parts: the smallest shingles serve as well
                            spare.append((band, most, w, mix(s[: most + 1] ^ U(band + 1))))
                        else:
                            spare.append((band, most, w, w[:0]))
                    for _, most, w, x in spare:
                        words += [np.array([len(w), len(x), most], U), w, x]
                    with np.errstate(over="ignore"):
                        rows.append((len(s), int(mix(s).sum(dtype=U).view(np.int64)), int(np.bitwise_xor.reduce(mix(s + U(7))).view(np.int64)), sketch(s).tobytes(), np.concatenate(words).tobytes()))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.binary()) for c in columns[3:])],
                    ["doc_id", "n", "f1", "f2", "sketch", "words"],
                )

        return self.docs.mapInArrow(read, "doc_id long, n long, f1 long, f2 long, sketch binary, words binary")

    def _frequent(self, sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """The slots of frequent words with their counts."""

        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(SLOTS, np.uint32)
            for batch in batches:
                words = [w for blob in batch.column(0).to_pylist() for w, _, _ in unpack(blob)]
                if words:
                    counts += np.bincount((np.concatenate(words) & U(SLOTS - 1)).astype(np.int64), minlength=SLOTS).astype(np.uint32)
            cuts = counts.reshape(64, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array([c.tobytes() for c in cuts], pa.binary())], ["cut", "counts"])

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for cut, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    sums[cut] = sums.get(cut, 0) + np.frombuffer(blob, np.uint32).astype(np.int64)
            for cut, c in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(c)) + cut * len(c)), pa.array(c)], ["slot", "count"])

        counts = self.ws.keep(sets.select("words").mapInArrow(tally, "cut int, counts binary").repartition("cut").mapInArrow(total, "slot long, count long"), "counts")
        mean = (counts.agg(F.sum("count")).first()[0] or 0) / SLOTS
        many = counts.where(F.col("count") > max(32, FREQUENT * mean)).orderBy("slot").toPandas()  # an eighth of the counters at most
        self.ws.drop("counts")
        return many["slot"].to_numpy(np.int64), many["count"].to_numpy(np.int64)

    def _records(self, sets: DataFrame) -> DataFrame:
        """(key, id, whole): a row for each word with which a set joins; whole: the key before salting."""
        slots, counts = self.frequent
        share = SHARE

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, ids, wholes = [], [], []
                for i, blob in zip(batch.column("id").to_pylist(), batch.column("words").to_pylist(), strict=True):
                    for w, x, most in unpack(blob):
                        at = np.searchsorted(slots, slot := (w & U(SLOTS - 1)).astype(np.int64))
                        hot = slots[np.minimum(at, len(slots) - 1)] == slot if len(slots) else np.zeros(len(w), bool)
                        light = w[~hot]
                        keys.append(light)
                        wholes.append(np.zeros(len(light), np.int64))
                        size = len(light)
                        if size <= most and hot.any():
                            salts = (counts[at[hot]] + share - 1) // share
                            salt = mix(np.array([i], np.int64).view(U)) % salts.astype(U)
                            heavy, salted = w[hot], salts > 1
                            with np.errstate(over="ignore"):
                                keys.append(np.where(salted, mix(heavy + salt + U(1)), heavy))
                            wholes.append(np.where(salted, heavy.view(np.int64), 0))
                            size += len(heavy)
                        keys.append(x)
                        wholes.append(np.zeros(len(x), np.int64))
                        ids.append(np.full(size + len(x), i, np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays([signed(np.concatenate(keys)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(wholes))], ["key", "id", "whole"])

        return sets.select("id", "words").mapInArrow(deal, "key long, id long, whole long")

    # verification

    def _verify(self, pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
        percent, n = self.percent, self.n

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b, na, nb, sa, sb = (batch.column(k).to_pylist() for k in range(6))
                keep = [linked(min(i, j), i, j, percent) and apart(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) <= allowed(i, j, percent) for i, j, x, y in zip(na, nb, sa, sb, strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in portions(batches):
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([s.tobytes() for s in shingle_sets(texts, n)], pa.binary())], ["id", "shingles"])

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sa, sb = ([np.frombuffer(x, U) for x in batch.column(k).to_pylist()] for k in (2, 3))
                keep = [linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent) for x, y in zip(sa, sb, strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        def ends(p: DataFrame, k: str) -> DataFrame:
            return self.ws.keep(p.select(F.explode(F.array("a", "b")).alias("id")).distinct(), f"{name}-{k}")

        def meet(p: DataFrame, of: DataFrame, columns: list[str]) -> DataFrame:
            right = of.select(F.col("id").alias("b"), *(F.col(c).alias(f"{c}_b") for c in columns))
            left = of.select(F.col("id").alias("a"), *(F.col(c).alias(f"{c}_a") for c in columns))
            return p.select("a", "b").join(right, "b").join(left, "a").select("a", "b", *(f"{c}_{x}" for c in columns for x in "ab"))

        pairs = self.ws.keep(pairs, f"{name}-pairs")
        marks = restrict(sets.select("id", "n", "sketch"), ends(pairs, "ids"), "id")
        close = self.ws.keep(meet(pairs, marks, ["n", "sketch"]).mapInArrow(near, "a long, b long"), f"{name}-close")
        texts = restrict(self.docs.select(F.col("doc_id").alias("id"), "text"), ends(close, "close-ids"), "id")
        shingles = texts.mapInArrow(whole, "id long, shingles binary").where("length(shingles) > 0")
        return self.ws.keep(meet(close, shingles, ["shingles"]).mapInArrow(exact, "a long, b long").distinct(), f"{name}-links")

    def links(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(rows of docs with their class, links (a, b) of class representatives that settle the components, components)."""
        ws = self.ws
        read = ws.keep(self._read(), "read")
        classes = read.where("n > 0 and doc_id is not null").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
        classes = ws.keep(classes, "classes")
        copies = ws.keep(classes.where("copies > 1"), "copies")
        rows = read.select("doc_id", "n", "f1", "f2").join(copies, ["n", "f1", "f2"], "left")
        rows = ws.keep(rows.withColumns({"rep": F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")), "copies": F.coalesce("copies", F.lit(1))}), "rows")
        mark = ["doc_id", "n", "f1", "f2"]
        spare = ws.keep(rows.where("doc_id <> rep").select(*mark).distinct(), "spare")
        sets = restrict(read.where("n > 0 and doc_id is not null"), spare, mark, "left_anti").select(F.col("doc_id").alias("id"), "n", "sketch", "words")
        self.frequent = self._frequent(sets)
        links, component = star_join(ws, lambda ids: self._records(sets if ids is None else restrict(sets, ids, "id")), lambda pairs, name: self._verify(pairs, sets, name), lambda members, nearest: near_arms(members, sets, self.percent, nearest))
        ws.drop("read")
        return rows, links, component

    def degrees(self, rows: DataFrame, component: DataFrame) -> DataFrame:
        """(rep, n_links): all links between class representatives, also of those in one component from the start.

        Both ends of a link are in one component, so each pair meets once: in its component, or in one pair of
        its blocks. The task intersects whole sets by their shingles' owners; only counts leave it.
        """
        ws, n, percent = self.ws, self.n, self.percent
        reps = rows.where("doc_id = rep").select(F.col("doc_id").alias("id"), "n").distinct().join(component, "id")
        per = reps.groupBy("component").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
        place = ws.keep(component.join(per, "component").select("id", "component", "blocks"), "places")
        other = restrict(rows.where("doc_id <> rep").select(F.col("doc_id").alias("id"), "n", "f1", "f2"), place.select("id"), "id")
        other = ws.keep(other.distinct(), "other-classes")  # texts of a placed id that another id stands for
        texts = self.docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(place) if place.count() <= BROADCAST_IDS // 4 else place, "id")

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in portions(batches):
                sets = list(shingle_sets(texts, n))
                with np.errstate(over="ignore"):
                    marks = [(len(s), int(mix(s).sum(dtype=U).view(np.int64)), int(np.bitwise_xor.reduce(mix(s + U(7))).view(np.int64))) if len(s) else (0, 0, 0) for s in sets]
                columns = [batch.column(k) for k in ("id", "component", "blocks")]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, pa.int64()) for c in zip(*marks, strict=True)), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "component", "blocks", "n", "f1", "f2", "shingles"])

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            group, held = None, []

            def flush() -> tuple[np.ndarray, np.ndarray]:
                ids, block, sets = zip(*held, strict=True)
                return count_links(np.array(ids, np.int64), np.array(block), list(sets), group[1] != group[2], percent)

            for batch in batches:
                out = []
                for c, lo, hi, i, x, s in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                    if group != (c, lo, hi):
                        if held:
                            out.append(flush())
                        group, held = (c, lo, hi), []
                    held.append((x, i, np.frombuffer(s, U)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(y)) for y in zip(*out, strict=True)], ["rep", "n_links"])
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(y) for y in flush()], ["rep", "n_links"])

        sets = texts.select("id", "component", "blocks", "text").mapInArrow(whole, "id long, component long, blocks int, n long, f1 long, f2 long, shingles binary").where("n > 0")
        sets = restrict(sets, other, ["id", "n", "f1", "f2"], "left_anti").withColumn("i", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        sets = sets.select("id", "component", "i", "shingles", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
        sets = sets.select("component", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "id", "shingles")
        counts = sets.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi").mapInArrow(count, "rep long, n_links long")
        return ws.keep(counts.groupBy("rep").agg(F.sum("n_links").alias("n_links")), "degrees")

    def classes(self, counted: bool = True) -> DataFrame:
        """counted: with n_links; else it is null."""
        rows, _, component = self.links()
        degree = self.degrees(rows, component) if counted else component.select(F.col("id").alias("rep"), F.lit(None).cast("long").alias("n_links"))
        of = component.select(F.col("id").alias("rep"), "component").join(degree, "rep", "left")
        out = rows.join(of, "rep", "left").select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"),
            (F.coalesce("n_links", F.lit(0)) if counted else F.lit(None).cast("long")).alias("n_links"),
            F.col("copies").alias("n_copies"),
        )
        return out


def unpack(blob: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(part words, spare words, most differences) of each band."""
    x, at = np.frombuffer(blob, U), 0
    while at < len(x):
        w, s, most = (int(v) for v in x[at : at + 3])
        yield x[at + 3 : at + 3 + w], x[at + 3 + w : at + 3 + w + s], most
        at += 3 + w + s
