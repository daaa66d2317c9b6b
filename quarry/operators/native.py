"""Native (exponential) histograms: rows (labels, ts_ms, count, sum, scale, zero_count, positive_offset, positive_counts, negative_offset, negative_counts).

Bucket i of a side holds what lies in (base^i, base^(i+1)] with base = 2^(2^-scale). Scales above 8 are brought to 8 by
joining neighbours; below -4 there is no such histogram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N

#: The scales that a native histogram can have.
LEAST_SCALE, MOST_SCALE = -4, 8


def _side(name: str, sign: int) -> Column:
    """Buckets (lo, hi, n) of one side in ascending order; empty ones are left out."""
    down = F.greatest(F.lit(0), F.col("scale") - MOST_SCALE)
    scale = F.least(F.lit(MOST_SCALE), F.col("scale"))
    counts, offset = F.col(f"{name}_counts"), F.col(f"{name}_offset")
    index = lambda j: F.floor((offset + j) / F.pow(F.lit(2.0), down)).cast("int")
    edge = lambda i: F.pow(F.lit(2.0), i * F.pow(F.lit(2.0), -scale))
    each = F.filter(F.transform(counts, lambda n, j: F.struct(index(j).alias("i"), n.alias("n"))), lambda e: e["n"] > 0)
    one = lambda e: F.struct((sign * edge(e["i"] + (0 if sign > 0 else 1))).alias("lo"), (sign * edge(e["i"] + (1 if sign > 0 else 0))).alias("hi"), e["n"].cast("double").alias("n"))
    return F.array_sort(F.transform(each, one))


def buckets(df: DataFrame) -> DataFrame:
    """df with ``buckets`` ARRAY<STRUCT<lo, hi, n>> over all sides in ascending order. The zero bucket reaches to a side that has something."""
    low, high = F.size("negative_counts") > 0, F.size("positive_counts") > 0
    tiny = 2.938735877055719e-39  # 2^-128
    zero = F.when(F.col("zero_count") > 0, F.array(F.struct(F.when(low | ~high, -tiny).otherwise(0.0).alias("lo"), F.when(high | ~low, tiny).otherwise(0.0).alias("hi"), F.col("zero_count").cast("double").alias("n")))).otherwise(F.array().cast("array<struct<lo:double,hi:double,n:double>>"))
    wrong = F.when(F.col("scale") < LEAST_SCALE, F.raise_error(F.lit("no histogram has this scale")).cast("array<struct<lo:double,hi:double,n:double>>"))
    return df.withColumn("buckets", F.coalesce(wrong, F.concat(_side("negative", -1), zero, _side("positive", 1))))


def quantile(q: float) -> Column:
    """Of ``buckets`` and ``count``: geometric within a bucket, linear in the one around zero."""
    b, rank = F.col("buckets"), F.col("count") * q
    sums = F.transform(F.sequence(F.lit(1), F.size(b)), lambda k: F.aggregate(F.slice(b, F.lit(1), k), F.lit(0.0), lambda a, x: a + x["n"]))
    k = F.least(F.size(F.filter(sums, lambda s: s < rank)), F.size(b) - 1)
    lo, hi, n = (F.get(b, k)[x] for x in ("lo", "hi", "n"))
    share = (rank - F.when(k > 0, F.get(sums, k - 1)).otherwise(0.0)) / n
    grown = F.when(lo > 0, lo * F.pow(hi / lo, share)).otherwise(hi * F.pow(lo / hi, 1 - share))
    inside = F.when((lo <= 0) & (hi >= 0), lo + (hi - lo) * share).otherwise(grown)
    return F.when((F.col("count") == 0) | (F.size(b) == 0), N.nan()).when(F.lit(q < 0), -N.inf()).when(F.lit(q > 1), N.inf()).otherwise(inside)


#: Functions of a histogram that take nothing else.
PARTS = {"histogram_count": lambda: F.col("count").cast("double"), "histogram_sum": lambda: F.col("sum"), "histogram_avg": lambda: N.div(F.col("sum"), F.col("count").cast("double"))}
