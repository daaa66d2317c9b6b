"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered in the order of doc_id (then of the text's hash). A Feistel network permutes the
smallest even-bit domain that holds all numbers; a value that falls outside is permuted again until it
falls inside (cycle walking), which is a bijection on the numbers themselves. The permuted number gives
shard ``p % shards`` and slot ``p // shards``: shard sizes differ by one at most, slots have no gaps, and
shard and slot of any row number can be computed (``locate``), as can the row of a slot (``row_of``).

Numbering takes one range shuffle of the rows and one written table; only a count for each partition
goes to the driver. Edge cases: null doc_ids come first; equal rows take neighbouring numbers in any
order (they are interchangeable); null text has crc32 of empty text; an empty table gives no rows;
columns of the input named like an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, Workspace, mix

ROUNDS = 6


def half_bits(n: int) -> int:
    return max(1, (max(1, n - 1).bit_length() + 1) // 2)


def _keys(seed: int) -> np.ndarray:
    return mix(np.arange(1, ROUNDS + 1, dtype=U) + mix(np.array([seed], U)))


def _network(x: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    mask, b = U((1 << bits) - 1), U(bits)
    left, right = x >> b, x & mask
    for k in keys:
        with np.errstate(over="ignore"):
            left, right = right, left ^ (mix(right + k) & mask)
    return left << b | right


def _walk(x: np.ndarray, n: int, bits: int, keys: np.ndarray, network) -> np.ndarray:
    y = network(x.astype(U), bits, keys)
    while (out := np.flatnonzero(y >= U(n))).size:
        y[out] = network(y[out], bits, keys)
    return y.astype(np.int64)


def permute(rows: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Where each row number in 0 .. n - 1 goes."""
    return _walk(rows, n, half_bits(n), _keys(seed), _network)


def invert(places: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    def back(x: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
        mask, b = U((1 << bits) - 1), U(bits)
        left, right = x >> b, x & mask
        for k in keys[::-1]:
            with np.errstate(over="ignore"):
                left, right = right ^ (mix(left + k) & mask), left
        return left << b | right

    return _walk(places, n, half_bits(n), _keys(seed), back)


def locate(rows: np.ndarray, n: int, shards: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of row numbers."""
    p = permute(rows, n, seed)
    return p % shards, p // shards


def row_of(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, seed: int = 0) -> np.ndarray:
    return invert(np.asarray(slot) * shards + np.asarray(shard), n, seed)


def number(df: DataFrame, ws: Workspace, *order: str) -> tuple[DataFrame, int]:
    """df with ``row``, its place from 0 in the order given, and the number of rows."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # the boundaries of a range shuffle are sampled anew each time it runs: numbers are taken from what was written
    written = ws.keep(dealt.withColumns({"shard:part": F.spark_partition_id(), "shard:at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "numbered")
    sizes = {r["shard:part"]: r["n"] for r in written.groupBy("shard:part").agg(F.count("*").alias("n")).collect()}
    before = dict(zip(sorted(sizes), np.concatenate([[0], np.cumsum([sizes[k] for k in sorted(sizes)])]).tolist(), strict=False))
    starts = df.sparkSession.createDataFrame(list(before.items()), "`shard:part` int, `shard:start` long")
    rows = written.join(F.broadcast(starts), "shard:part").withColumn("row", F.col("shard:start") + F.col("shard:at"))
    return rows.drop("shard:part", "shard:at", "shard:start"), sum(sizes.values())


def shard(df: DataFrame, shards: int = 24, seed: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df with shard, slot and row."""
    ws = Workspace(df.sparkSession)
    df = df.drop("shard", "slot", "row", "shard:tie").withColumn("shard:tie", F.xxhash64(text))
    rows, n = number(df, ws, key, "shard:tie")

    def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            at, slot = locate(s.to_numpy(), n, shards, seed)
            yield pd.DataFrame({"shard": at.astype(np.int32), "slot": slot})

    at = F.pandas_udf(place, "shard int, slot long")
    return rows.withColumn("shard:place", at("row")).select("*", "shard:place.shard", "shard:place.slot").drop("shard:place", "shard:tie")
