"""Token ids in word-aligned binary form: Simple-8b.

Each 64-bit word has a 4-bit selector in its low bits, which says how many ids of how many bits follow.
Ids are packed in blocks of 256; a table of word offsets for each block lets any block be decoded alone,
and decoding is vectorised over all words of a selector. Values of more than 60 bits are written as 0 and
kept apart as escapes (place, value).

A file set is a Parquet table of chunks of about 64 Ki ids: doc_ids, lengths, packed words, block offsets
and escapes, in ascending order of doc_id (then of the text's hash); ``part`` and ``seq`` give the order of
chunks. A document's ids are never split over chunks; a very long one makes a chunk of its own.

Only sums of ids for each part go to the driver. Edge cases: null text is the empty text (just the end id);
null doc_ids come first; equal rows are neighbours; an empty table writes an empty file set.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, Words, Workspace, mix, portions

#: Fixed values of Simple-8b: ids in a word and bits of each, by selector.
COUNT = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK = 256
CHUNK = 1 << 16


def _selectors(blocks: np.ndarray) -> np.ndarray:
    """For each place the first selector that fits there; places after a block's end count as zeros."""
    n, width = blocks.shape
    choice = np.full((n, width), 15, np.uint8)
    open_ = np.ones((n, width), bool)
    for s in range(15):
        fits = np.ones((n, width + 240), bool)
        fits[:, :width] = blocks < (U(1) << U(BITS[s])) if BITS[s] else blocks == 0
        if not fits[:, :width].any():
            continue
        run, have = fits, 1
        while have < COUNT[s]:  # run[i]: `have` places from i on fit
            step = min(have, COUNT[s] - have)
            longer = run.copy()
            longer[:, :-step] &= run[:, step:]
            run, have = longer, have + step
        take = open_ & run[:, :width]
        choice[take] = s
        open_ &= ~take
    return choice


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Packed words, the word offset of each block, places and values of escapes."""
    ids = ids.astype(U)
    at = np.flatnonzero(ids >= U(1) << U(60))
    values = ids[at]
    if len(at):
        ids = ids.copy()
        ids[at] = 0
    n = -(-len(ids) // BLOCK)
    blocks = np.zeros(n * BLOCK, U)
    blocks[: len(ids)] = ids
    sizes = np.full(n, BLOCK)
    if n:
        sizes[-1] = len(ids) - (n - 1) * BLOCK
    choice = _selectors(blocks.reshape(n, BLOCK)).ravel()
    # all blocks take their next word together
    owner, place, pos, live = [], [], np.zeros(n, np.int64), np.arange(n)
    while len(live):
        owner.append(live)
        place.append(pos[live])
        pos[live] += COUNT[choice[live * BLOCK + pos[live]]]
        live = live[pos[live] < sizes[live]]
    if not n:
        return np.zeros(0, U), np.zeros(0, np.uint32), at, values
    owner, place = np.concatenate(owner), np.concatenate(place)
    order = np.lexsort((place, owner))
    owner, start = owner[order], (owner * BLOCK + place)[order]
    chosen = choice[start]
    words = chosen.astype(U)
    padded = np.concatenate([blocks, np.zeros(240, U)])
    end = (owner + 1) * BLOCK
    for s in np.unique(chosen):
        if BITS[s]:
            rows = np.flatnonzero(chosen == s)
            for k in range(COUNT[s]):
                at_k = start[rows] + k
                words[rows] |= np.where(at_k < end[rows], padded[at_k], U(0)) << U(4 + k * BITS[s])
    return words, np.searchsorted(owner, np.arange(n)).astype(np.uint32), at, values


def decode(words: np.ndarray, offsets: np.ndarray, n: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The n ids."""
    out = np.zeros(n, U)
    if not n:
        return out
    chosen = (words & U(15)).astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(COUNT[chosen])])
    block = np.searchsorted(offsets, np.arange(len(words)), "right") - 1
    start = sums[:-1] - sums[offsets[block]] + block * BLOCK
    end = np.minimum((block + 1) * BLOCK, n)
    for s in np.unique(chosen):
        if BITS[s]:
            rows = np.flatnonzero(chosen == s)
            mask = U((1 << int(BITS[s])) - 1)
            for k in range(COUNT[s]):
                to = start[rows] + k
                ok = to < end[rows]
                out[to[ok]] = words[rows[ok]] >> U(4 + k * BITS[s]) & mask
    out[at] = values
    return out


#: Stands between words that are encoded in one go; one id, which only itself gives.
MARK = b"\x01"
TOGETHER = 300
#: Fixed value: a pre-tokenizer's pattern after which a stop that follows a letter or digit is a piece of its own.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
STOPS = np.isin(np.arange(256), list(b".,;:!?"))
PLAIN = np.array([c < 128 and chr(c).isalnum() for c in range(256)])
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def spelling(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word, and what it is of: the size and the first 16 bytes (four rows)."""
    size = ends - starts
    eight = np.ndarray((len(data) + 9,), "<u8", np.concatenate([data, np.zeros(16, np.uint8)]), 0, (1,))
    low, high = eight[starts] & _LOW_BYTES[np.minimum(size, 8)], eight[np.minimum(starts + 8, len(data))] & _LOW_BYTES[np.clip(size - 8, 0, 8)]
    with np.errstate(over="ignore"):
        return np.stack([mix(low + U(0x9E3779B97F4A7C15) * high + size.astype(U)), low, high, size.astype(U)])


class WordCache:
    """Ids of white-space separated pieces, each encoded once; emptied when it has more than ``most``.

    Pieces of up to 16 bytes are found by hash in a sorted table and compared with what stands there; longer ones,
    and those whose hash is another's, stand in a dictionary. If the tokenizer lower-cases, so are the pieces (A-Z,
    unless a combining mark could join a letter of one case only, or an added token would appear); if its pattern is PIECES, a single stop at a
    word's end is a piece of its own. Both leave fewer to encode.
    """

    def __init__(self, tokenizer, end: int, most: int = 1_500_000):
        self.tokenizer, self.end, self.most = tokenizer, end, most
        form = json.loads(tokenizer.to_str())
        first, then = ((form[k] or {}) for k in ("normalizer", "pre_tokenizer"))
        self.added = [t["content"].lower().encode() for t in form["added_tokens"]]
        self.folds = any(x["type"] == "Lowercase" for x in first.get("normalizers", [first] if first else []))
        self.stops = any(x.get("pattern", {}).get("Regex") == PIECES for x in then.get("pretokenizers", [then]))
        self._empty()

    def _empty(self) -> None:
        self.others: dict[bytes, int] = {}
        self.known, self.piece = np.zeros((4, 0), U), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 1
        self.first, self.size, self.n = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 1
        self.flat[0], self.size[0] = self.end, 1  # piece 0: the end of a document

    def _pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word's piece."""
        marks = spelling(data, starts, ends)
        _, rep, of = np.unique(marks[0], return_index=True, return_inverse=True)
        some = marks[:, rep]
        at = np.searchsorted(self.known[0], some[0])
        taken, short = np.zeros(len(rep), bool), some[3] <= 16
        if self.known.shape[1]:
            there = self.known[:, np.minimum(at, self.known.shape[1] - 1)]
            taken = (at < self.known.shape[1]) & (there[0] == some[0])
            hit = taken & (there == some).all(0) & short
        else:
            hit = taken
        new = np.flatnonzero(~taken & short)
        fresh = [data[a:b].tobytes() for a, b in zip(starts[rep[new]].tolist(), ends[rep[new]].tolist(), strict=True)]
        found = np.full(len(rep), -1)
        found[hit] = self.piece[at[hit]]
        found[new] = self.n + np.arange(len(new))
        number = found[of]
        odd = number < 0
        for x, y in zip(some[1:], marks[1:], strict=True):
            odd |= x[of] != y
        odd = np.flatnonzero(odd)
        blob = {}
        for k, a, b in zip(odd.tolist(), starts[odd].tolist(), ends[odd].tolist(), strict=True):
            word = data[a:b].tobytes()
            if word not in self.others and word not in blob:
                blob[word] = self.n + len(fresh) + len(blob)
            number[k] = blob.get(word, -1) if word in blob else self.others[word]
        self._learn([*fresh, *blob])
        self.others |= blob
        self.known = np.insert(self.known, at[new], some[:, new], 1)
        self.piece = np.insert(self.piece, at[new], found[new])
        return number

    def _learn(self, words: list[bytes]) -> None:
        if not words:
            return
        flat, sizes = self._ids(words)
        n = len(sizes)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + n > len(self.first):
            self.first, self.size = np.concatenate([self.first, self.first * 0]), np.concatenate([self.size, self.size * 0])
        self.flat[self.used : self.used + len(flat)] = flat
        self.first[self.n : self.n + n] = self.used + np.cumsum(sizes) - sizes
        self.size[self.n : self.n + n] = sizes
        self.used, self.n = self.used + len(flat), self.n + n

    def _ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words and the number of each; they are encoded ``TOGETHER`` at a time with a mark between."""
        (mark,) = self.tokenizer.encode(MARK.decode(), add_special_tokens=False).ids
        odd = [w for w in words if MARK in w]
        if odd:  # a word that holds the mark is encoded alone
            one = {w: np.array(self.tokenizer.encode(w.decode(), add_special_tokens=False).ids, np.uint32) for w in odd}
            flat, sizes = self._ids([w for w in words if MARK not in w])
            rest = iter(np.split(flat, np.cumsum(sizes)[:-1]))
            every = [one[w] if w in one else next(rest) for w in words]
            return np.concatenate(every), np.array([len(x) for x in every], np.int64)
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        texts = [((b" %b " % MARK).join(words[k : k + TOGETHER]) + b" " + MARK).decode("utf-8") for k in range(0, len(words), TOGETHER)]
        few = (self.tokenizer.encode_batch_fast(texts[k : k + 16], add_special_tokens=False) for k in range(0, len(texts), 16))
        flat = np.concatenate([np.array(e.ids, np.uint32) for some in few for e in some])
        at = np.flatnonzero(flat == mark)
        return np.delete(flat, at), np.diff(at, prepend=-1) - 1

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and the number of ids of each."""
        if self.n > self.most:
            self._empty()
        words = Words(texts, lower=self.folds and not any(b"\xcc" in t or b"\xcd" in t or any(a in t.lower() for a in self.added) for t in texts), hashed=False)
        data, starts, ends = words.data, words.starts, words.ends
        if self.stops:
            before = data[ends - 2]
            letter = PLAIN[before] | (data[ends - 3] == 0xC3) & (before != 0x97) & (before != 0xB7) & (before >= 0x80) & (ends - starts > 2)
            cut = ends[STOPS[data[ends - 1]] & letter & (ends - starts > 1)] - 1
            starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
        at = np.searchsorted(starts, words.begins[1:])
        pieces = np.insert(self._pieces(data, starts, ends), at, 0)
        sizes = self.size[pieces]
        stops = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.first[pieces] - (stops - sizes), sizes) + np.arange(stops[-1] if len(stops) else 0)]
        last = stops[at + np.arange(len(at))] if len(at) else np.zeros(0, np.int64)
        return ids, np.diff(last, prepend=0)


_CACHES: dict[tuple, WordCache] = {}


def _cache(path: str, end: int) -> WordCache:
    """One for each Python worker. The vocabulary's pre-tokenizer never joins over white space, so pieces are independent."""
    if (path, end) not in _CACHES:
        from tokenizers import Tokenizer

        _CACHES[path, end] = WordCache(Tokenizer.from_file(path), end)
    return _CACHES[path, end]


FILE = "part int, seq long, first long, doc_ids array<long>, lengths array<int>, n_ids long, words binary, offsets binary, escapes_at binary, escapes binary"


def write(docs: DataFrame, path: str, vocabulary: str, end: int = 1) -> None:
    """Writes the ids of docs as a file set."""
    from ..session import ship

    ship(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select(F.spark_partition_id().alias("part"), "doc_id", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cache = _cache(vocabulary, end)
        seq = first = 0
        for batch, texts in portions(batches, most=1 << 21):
            ids, sizes = cache.encode(texts)
            doc_ids, part = batch.column("doc_id").to_pylist(), batch.column("part")[0].as_py()
            stops = np.cumsum(sizes)
            a = 0
            while a < len(sizes):
                begin = int(stops[a] - sizes[a])
                b = max(a + 1, int(np.searchsorted(stops, begin + CHUNK, "right")))
                own = ids[begin : stops[b - 1]]
                words, offsets, at, values = encode(own)
                blobs = [words.tobytes(), offsets.tobytes(), at.astype(np.uint64).tobytes(), values.tobytes()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([first], pa.int64()), pa.array([doc_ids[a:b]], pa.list_(pa.int64())), pa.array([sizes[a:b].tolist()], pa.list_(pa.int32())), pa.array([len(own)], pa.int64()), *(pa.array([x], pa.binary()) for x in blobs)],
                    ["part", "seq", "first", "doc_ids", "lengths", "n_ids", "words", "offsets", "escapes_at", "escapes"],
                )
                seq, first, a = seq + 1, first + len(own), b

    rows.mapInArrow(pack, FILE).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read(spark, path: str) -> DataFrame:
    """For each document of a file set: doc_id, start, n_tokens, ids_crc32 and the ids (little-endian unsigned 32 bits)."""
    chunks = spark.read.schema(FILE).parquet(path)
    sums = {r["part"]: r["n"] for r in chunks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    before = dict(zip(sorted(sums), np.concatenate([[0], np.cumsum([sums[k] for k in sorted(sums)])]).tolist(), strict=False))
    starts = spark.createDataFrame(list(before.items()), "part int, start long")  # a row for each part

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = decode(np.frombuffer(r["words"], U), np.frombuffer(r["offsets"], np.uint32), r["n_ids"], np.frombuffer(r["escapes_at"], U).astype(np.int64), np.frombuffer(r["escapes"], U)).astype("<u4")
                stops = np.cumsum(r["lengths"]) if r["lengths"] else np.zeros(0, np.int64)
                begins = stops - np.array(r["lengths"], np.int64)
                own = [ids[a:b].tobytes() for a, b in zip(begins, stops, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array(begins + r["first"] + r["start"], pa.int64()), pa.array(r["lengths"], pa.int64()), pa.array([zlib.crc32(x) for x in own], pa.int64()), pa.array(own, pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    joined = chunks.join(F.broadcast(starts), "part")
    return joined.mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def pack_and_read(docs: DataFrame, vocabulary: str, end: int = 1) -> DataFrame:
    ws = Workspace(docs.sparkSession)
    write(docs, f"{ws.path}/ids", vocabulary, end)
    return read(docs.sparkSession, f"{ws.path}/ids")
