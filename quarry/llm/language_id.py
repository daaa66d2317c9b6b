"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; every run of 2 and of 3 characters that starts in the text is hashed into
``BUCKETS`` counters. Training sums the counters of each language; the matrix of smoothed log
probabilities (languages x buckets, fixed size) is what scoring needs, and each Arrow batch is scored
with numpy: one gather and one prefix sum for each language.

``max_rows`` bounds the labelled rows that the fit reads (by default 40,000; chosen by a hash of doc_id,
so every run takes the same). Every row is scored, in full.

Edge cases: null text, or no letter in it: ``und`` with score 0. No labelled row: all are ``und``. Ties go
to the first language by name. Null doc_id: not held out, and never learnt from. Texts of any length are read
whole. Repeated rows are judged alike. Other columns are kept on demand and never read; ``lang_pred`` and ``score``
of the input are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import portions

BUCKETS = 1 << 16
MAX_ROWS = 40_000
#: A row of the model takes 256 KB on every executor; more labels than there are languages is an error.
MAX_LANGS = 1000
UNKNOWN = "und"
_A, _B, _C = (np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams in two rows (n = 2, 3), and where each text starts and ends among them."""
    parts = [t.lower() for t in texts]
    c = np.frombuffer("".join(p + "  " for p in parts).encode("utf-32-le", "surrogatepass") + b" \0\0\0" * 2, np.uint32)
    sizes = np.array([len(p) for p in parts], np.int64)
    ends = np.cumsum(sizes + 2) - 2
    with np.errstate(over="ignore"):
        two = c[:-2] * _A + c[1:-1] * _B
        three = two + c[2:] * _C
        grams = np.stack([(two ^ two >> np.uint32(15)) * _B >> np.uint32(16), (three ^ three >> np.uint32(15)) * _C >> np.uint32(16)])
    return grams, ends - sizes, ends


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class NaiveBayes:
    def __init__(self, langs: list[str], counts: np.ndarray, rows: np.ndarray, alpha: float = 0.5):
        self.langs = langs
        self.logp = np.log((counts + alpha) / (counts.sum(1, keepdims=True) + alpha * BUCKETS)).astype(np.float32)
        self.prior = np.log(rows / rows.sum()) if len(langs) else np.zeros(0)

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language, and its posterior."""
        grams, a, b = features(texts)
        score = np.zeros((len(self.langs), len(texts)))
        for k in range(len(self.langs)):
            sums = np.zeros(grams.shape[1] + 1)
            np.cumsum(self.logp[k][grams[0]] + self.logp[k][grams[1]], dtype=np.float64, out=sums[1:])
            score[k] = sums[b] - sums[a] + self.prior[k]
        best = score.argmax(0)
        with np.errstate(under="ignore"):
            p = 1 / np.exp(score - score[best, np.arange(len(texts))]).sum(0)
        return best, p


def fit(docs: DataFrame, max_rows: int = MAX_ROWS, seed: int = 0) -> NaiveBayes:
    """docs: text, lang and doc_id of the rows to learn from."""
    ship(docs.sparkSession)
    rows = docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "text", "lang")
    n, langs = rows.agg(F.count("*"), F.approx_count_distinct("lang")).first()
    if langs > MAX_LANGS:
        raise ValueError(f"about {langs} languages are labelled; a model holds {MAX_LANGS} at most")
    if n > max_rows:
        rows = rows.where((F.xxhash64("doc_id", F.lit(seed)) % 1_000_000 + 1_000_000) % 1_000_000 < int(1_000_000 * max_rows / n))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch, texts in portions(batches):
            by: dict[str, list[str]] = {}
            for lang, t in zip(batch.column("lang").to_pylist(), texts, strict=True):
                by.setdefault(lang, []).append(t.decode("utf-8", "replace"))
            for lang, own in by.items():
                grams, a, b = features(own)
                inside = np.zeros(grams.shape[1] + 1, np.int32)
                np.add.at(inside, a, 1)
                np.add.at(inside, b, -1)
                inside = np.cumsum(inside[:-1]) > 0
                sums[lang] = sums.get(lang, 0) + np.bincount(grams[:, inside].ravel().astype(np.int64), minlength=BUCKETS)
                seen[lang] = seen.get(lang, 0) + len(own)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([seen[k] for k in sums], pa.int64()), pa.array([v.astype(np.int64).tobytes() for v in sums.values()], pa.binary())], ["lang", "n", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}
        for batch in batches:
            for lang, n, blob in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                s = sums.setdefault(lang, [0, 0])
                s[0], s[1] = s[0] + n, s[1] + np.frombuffer(blob, np.int64)
        for lang, (n, c) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([n], pa.int64()), pa.array([c.tobytes()], pa.binary())], ["lang", "n", "counts"])

    schema = "lang string, n long, counts binary"
    found = sorted(rows.mapInArrow(tally, schema).repartition("lang").mapInArrow(total, schema).collect(), key=lambda r: r["lang"])  # a fixed-size row for each language
    return NaiveBayes([r["lang"] for r in found], np.array([np.frombuffer(r["counts"], np.int64) for r in found]).reshape(-1, BUCKETS), np.array([r["n"] for r in found], float))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: NaiveBayes, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with lang_pred and score; input columns of these names are replaced."""
    spark = docs.sparkSession
    ship(spark)
    keep = tuple(c for c in keep if c not in ("lang_pred", "score"))
    sent = spark.sparkContext.broadcast(model)
    part = docs.select(*keep, *(() if "text" in keep else ("text",)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = np.array([*m.langs, UNKNOWN], object)
        for batch, _ in portions(batches):
            texts = batch.column("text").to_pylist()
            known = np.array([bool(m.langs) and has_letter(t) for t in texts], bool)
            best, p = np.full(len(texts), len(m.langs)), np.zeros(len(texts))
            if known.any():
                best[known], p[known] = m.predict([t for t, k in zip(texts, known, strict=True) if k])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(names[best], pa.string()), pa.array(p)], [*keep, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in part.select(*keep).schema.fields)
    return part.mapInArrow(score, f"{fields}, lang_pred string, score double")
