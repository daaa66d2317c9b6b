"""What the corpus operators share: the shared work folder, word hashing over Arrow batches,
joins behind a size check, streaming over sorted runs, and connected components.

Nothing here brings rows of the corpus to the driver. Intermediate tables are Parquet files in the
folder that ``spark.checkpoint.dir`` names, so a lost executor never loses them.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: The white space of the contracts; everything else is part of a word.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Ids that are sent to every executor at most (8 bytes each); beyond it a shuffled join does the work.
BROADCAST_IDS = 2_000_000

U = np.uint64
_ODD = U(0x9E3779B97F4A7C15)


class Workspace:
    """Tables of one run in the folder all executors share."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        ship(spark)
        top = spark.conf.get("spark.checkpoint.dir", None)
        if not top:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            top = getattr(spark, "_quarry_dir", None) or "file://" + tempfile.mkdtemp(prefix="quarry-")
            spark._quarry_dir = top
        self.path = f"{top.rstrip('/')}/quarry-{uuid.uuid4().hex}"
        atexit.register(self.close)  # results read these tables as long as the session lasts

    def close(self) -> None:
        with contextlib.suppress(Exception):  # the session may be gone
            self.drop("")

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and returns what was written: the lineage ends here."""
        where = f"{self.path}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def restrict(df: DataFrame, ids: DataFrame, on: str | list[str], how: str = "left_semi") -> DataFrame:
    """df with (left_semi) or without (left_anti) the ids; ids: a small written table with the column ``on``.

    The ids go to every executor only if they are counted and few; else both sides are shuffled.
    """
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, on, how)


# --- hashing -------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    with np.errstate(over="ignore"):
        x = x.astype(U, copy=True)
        x ^= x >> U(33)
        x *= U(0xFF51AFD7ED558CCD)
        x ^= x >> U(33)
        x *= U(0xC4CEB9FE1A85EC53)
        x ^= x >> U(33)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x2545F4914F6CDD1D))
_POWERS: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = max(1 << 16, n + n // 4)
        for k, base in enumerate((int(_ODD), pow(int(_ODD), -1, 1 << 64))):
            p = np.full(size, U(base))
            p[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[k] = np.cumprod(p, dtype=U)
    return _POWERS[0][:n], _POWERS[1][:n]


def rolling(data: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """hashes(starts, ends) of byte ranges of data, by prefix sums."""
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, U)
        np.cumsum(_BYTE[data] * up[:-1], dtype=U, out=sums[1:])

    def hashes(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * U(0x9FB21C651E98DF25))

    return hashes


SEPARATES = np.zeros(256, bool)
SEPARATES[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """The words of some texts: ``first[i]:first[i + 1]`` are those of text i; ``hash`` has a value for each word."""

    def __init__(self, texts: list[bytes], lower: bool = True, separates: np.ndarray = SEPARATES, hashed: bool = True):
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        if lower:
            data = LOWER[data]
        inside = ~separates[data]
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
        self.data, self.starts, self.ends = data, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        self.first = np.searchsorted(self.starts, self.begins)
        self.hash = rolling(data)(self.starts, self.ends) if hashed else None

    def __len__(self) -> int:
        return len(self.starts)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each run of n neighbours of h, as if h were one text."""
    size = max(0, len(h) - n + 1)
    out = np.zeros(size, U)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * _ODD + mix(h[k : k + size] + U(k + 1))
    return mix(out)


def shingle_sets(texts: list[bytes], n: int = 5) -> Iterator[np.ndarray]:
    """For each text its distinct n-word shingles as sorted hashes; fewer words: the whole sequence as one."""
    words = Words(texts)
    every = grams(words.hash, n)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(every[a : b - n + 1])
        elif b > a:
            yield grams(words.hash[a:b], b - a) ^ U(b - a)
        else:
            yield np.zeros(0, U)


def portions(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with the bytes of their texts (null: empty), of about ``most`` bytes or one text.

    At the end the worker's free memory goes back to the system: it stands idle beside others until its next task.
    """
    for batch in batches:
        texts = batch.column(column).cast(pa.binary())
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)
        ends, a = np.cumsum(sizes), 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] - sizes[a] + most, "right")))
            yield batch.slice(a, b - a), [t or b"" for t in texts.slice(a, b - a).to_pylist()]
            a = b
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        pa.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


# --- sorted runs ---------------------------------------------------------------------------------


def runs(key: np.ndarray, last: object) -> np.ndarray:
    """Where a new key begins, given the key before the batch (or None)."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    if len(key) and last is not None:
        new[0] = key[0] != last
    return new


# --- components ----------------------------------------------------------------------------------


def connected_components(ws: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """(id, component) for every end of an edge (a, b): the smallest id reachable.

    Alternating large and small stars (Kiveris et al. 2014): each round is two aggregations and joins
    over the edges, never over whole components, and ends as a written table.
    """

    def hang(nodes: DataFrame, u: str, v: str) -> DataFrame:
        least = nodes.groupBy(u).agg(F.min(v).alias("m"))
        return nodes.join(least.withColumn("m", F.least("m", u)), u)

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e, seen, turn = ws.keep(e, f"{name}-0"), None, 0
    while (now := mark(e)) != seen:
        seen, turn = now, turn + 1
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = hang(both, "a", "b").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        hung = hang(large, "a", "b")
        small = hung.select("a", F.col("m").alias("b")).unionByName(hung.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        e = ws.keep(small, f"{name}-{turn}")
        ws.drop(f"{name}-{turn - 1}")
    ids = e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return ids.unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


# --- joins of near neighbours over shared keys ---------------------------------------------------


def _stars(ws: Workspace, records: DataFrame, name: str) -> DataFrame:
    """(a, b, whole): links b to the smallest id of its key; a row with b null for each salted key's smallest."""

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, centre = None, np.int64(0)
        for batch in batches:
            key, ids, whole = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if not len(key):
                continue
            new = runs(key, last)
            at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            c = np.where(at >= 0, ids[at], centre)
            last, centre = key[-1], c[-1]
            pair, top = c != ids, new & (whole != 0)
            if pair.any() or top.any():
                none = np.concatenate([np.zeros(pair.sum(), bool), np.ones(top.sum(), bool)])
                columns = [np.concatenate(x) for x in ((c[pair], c[top]), (ids[pair], c[top]), (whole[pair] * 0, whole[top]))]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], mask=none), pa.array(columns[2])], ["a", "b", "whole"])

    found = records.repartition("key").sortWithinPartitions("key", "id").mapInArrow(star, "a long, b long, whole long")
    return ws.keep(found.distinct(), name)


def _open(pairs: DataFrame, component: DataFrame) -> DataFrame:
    """The pairs whose ends are not yet in one component."""
    of = [component.select(F.col("id").alias(x), F.col("component").alias(f"c{x}")) for x in "ab"]
    joined = pairs.join(of[1], "b", "left").join(of[0], "a", "left")
    return joined.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _salted(ws: Workspace, records: DataFrame) -> DataFrame:
    """(a, b): the ids b of each key a that was dealt out in salts; of keys with the same ids one is enough."""
    every = ws.keep(records.where("whole <> 0").select(F.col("whole").alias("a"), F.col("id").alias("b")).distinct(), "salted")
    marks = [F.sum(F.xxhash64("b", F.lit(k)).cast("decimal(38,0)")).alias(f"m{k}") for k in range(2)]
    per = every.groupBy("a").agg(F.count("*").alias("n"), *marks)
    return restrict(every, ws.keep(per.groupBy("n", "m0", "m1").agg(F.min("a").alias("a")).select("a"), "salted-keys"), "a").select("a", "b")


def star_join(ws: Workspace, records: Callable[[DataFrame | None], DataFrame], verify: Callable[[DataFrame, str], DataFrame], arms: Callable[[DataFrame, bool], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Links among ids that share a key, and their components, without all pairs of any group.

    records(ids) gives (key, id, whole) of all ids or of those in a table (id); whole is the key before
    salting, 0 if it isn't salted. verify(pairs, name) keeps the linked ones of pairs (a, b).

    In each group ids are first proposed to the smallest only. If members of one centre's groups are then in
    different components, exactly those are compared with each other by arms(members, False), which is given
    (a, b, component) of the centres a that are open and must return all linked pairs of different components
    that follow one centre (others may be among them). A salted key has a centre for each salt, so
    its ids are given once more as followers of the whole key. arms(members, True) is asked first for a pair or so
    of each id, the likeliest one: a group of near copies that its centre is too far from is then one component
    before all pairs of different components are asked for. So every two ids that share a key end in one component
    or were compared: the components are those of all links.
    """
    first = _stars(ws, records(None), "stars")
    tops = first.where("whole <> 0").select(F.col("whole").alias("key"), F.col("a").alias("id"), F.lit(0).cast("long").alias("whole"))
    second = _stars(ws, tops, "tops")
    pairs = ws.keep(first.where("b is not null").unionByName(second.where("b is not null")).select("a", "b").distinct(), "candidates")
    links = verify(pairs, "stars")
    component = ws.keep(connected_components(ws, links, "cc1"), "component-1")
    centres = ws.keep(_open(pairs, component).select("a").distinct(), "open")
    salted = tops.limit(1).count() > 0
    if not salted and not centres.limit(1).count():
        return links, component
    members = ws.keep(restrict(pairs, centres, "a").select("a", "b"), "open-members")
    if salted:
        members = members.unionByName(_salted(ws, records(None)))
    met = pairs

    def follow() -> DataFrame:
        of = members.join(component.select(F.col("id").alias("b"), "component"), "b", "left")
        return of.select("a", "b", F.coalesce("component", "b").alias("component"))

    nearest = ws.keep(arms(follow(), True).join(met, ["a", "b"], "left_anti"), "nearest")
    links = ws.keep(links.unionByName(verify(nearest, "nearest-arms")), "links-near")
    component = ws.keep(connected_components(ws, links, "cc2"), "component-2")
    met = met.unionByName(nearest)
    rest = arms(follow(), False).join(met, ["a", "b"], "left_anti")
    links = ws.keep(links.unionByName(verify(rest, "rest")), "links-3")
    component = ws.keep(connected_components(ws, links, "cc3"), "component-3")
    ws.drop("stars", "tops", "candidates")
    return links, component


def star_links(ws: Workspace, records: DataFrame, verify: Callable[[DataFrame, str], DataFrame], arms: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, component) of the links among ids that share a key; no pairs but stars and links are made.

    records: (key, id, whole), never salted. Each id is verified with the smallest of each of its keys. Where
    followers of one of these centres are then in different components, arms(members), given (a, b, component) of
    such centres a, returns links (a, b) that join all followers of a centre that links join.
    """
    pairs = _stars(ws, records, "stars").select("a", "b")
    links = verify(pairs, "stars")
    component = ws.keep(connected_components(ws, links, "cc1"), "component-1")
    centres = ws.keep(_open(pairs, component).select("a").distinct(), "open")
    if not centres.limit(1).count():
        return component
    members = restrict(pairs, centres, "a").join(component.select(F.col("id").alias("b"), "component"), "b", "left")
    more = arms(ws.keep(members.select("a", "b", F.coalesce("component", "b").alias("component")), "open-members"))
    component = ws.keep(connected_components(ws, links.unionByName(more), "cc2"), "component-2")
    ws.drop("stars", "component-1", "open-members")
    return component


# --- removal of byte spans -----------------------------------------------------------------------


def named(docs: DataFrame) -> DataFrame:
    """rid, tie, doc_id, text: (rid, tie) names a row; rows that share it have the same doc_id and text."""
    return docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("rid"), F.xxhash64("text").alias("tie"), "doc_id", "text")


def merge(spans: np.ndarray) -> np.ndarray:
    """Sorted maximal runs of the union of spans (start, end)."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > reach[:-1]]))
    return np.stack([spans[first, 0], reach[np.append(first[1:] - 1, len(spans) - 1)]], 1)


def cut(text: bytes, spans: np.ndarray) -> bytes:
    """text without the merged spans."""
    at, out = 0, []
    for a, b in spans.tolist():
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def spans_by_row(ws: Workspace, docs: DataFrame, spans: DataFrame) -> DataFrame:
    """named(docs) with ``spans`` (a, b) of each row; only texts that have any are moved."""
    per = ws.keep(spans.groupBy("rid", "tie").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "spans")
    rows, have = named(docs), per.select("rid", "tie")
    some = restrict(rows, have, ["rid", "tie"]).join(per, ["rid", "tie"])
    none = restrict(rows, have, ["rid", "tie"], "left_anti").withColumn("spans", F.lit(None).cast(per.schema["spans"].dataType))
    return some.select(*none.columns).unionByName(none)


def span_array(x: list | None) -> np.ndarray:
    return np.array([(s["a"], s["b"]) for s in x or ()], np.int64).reshape(-1, 2)
