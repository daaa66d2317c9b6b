"""A corpus pipeline of five operators: language ID, near duplicates, decontamination, mixing, sharding.

``run(spark, sf_dir)`` applies STAGES to ``documents``; each stage's rows are written as Parquet in the shared
folder and read again as the next one's ``docs``. Columns beyond doc_id, text, lang and source pass through every
stage whatever their names are: operators see them renamed (see ``apart``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import feistel_shards, language_id, parity_join, source_mix, string_tiling
from quarry.llm.common import Workspace, restrict

#: A document goes if the posterior of its language is below this.
SURE = 0.5
SHARDS = 24
READ = ("doc_id", "text", "lang", "source")


def apart(docs: DataFrame) -> tuple[DataFrame, list]:
    """docs with its further columns under names that no operator uses, and what selects the columns as they were."""
    names = [c if c in READ else f"column:{k}" for k, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(f"`{n}`").alias(c) for n, c in zip(names, docs.columns, strict=True)]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language that the model is sure of. The fit never reads held-out rows.

    Null, empty or letterless texts go. Without labelled rows nothing is known and all go. Repeated rows are judged
    alike; a null doc_id is judged but never learnt from. Of equally likely languages the first by name counts.
    """
    docs, before = apart(docs)
    model = language_id.fit(docs.where(~language_id.held_out()))
    scored = language_id.identify(docs, model, tuple(docs.columns))
    return scored.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= SURE)).select(*before)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near copies, the one with the smallest doc_id.

    Rows without doc_id stay, as do null and wordless texts: they are copies of nothing. Of rows with equal doc_id
    and text one stays. Rows that share a doc_id but not the text are judged each by its text; they count as larger
    than all others, in the order of a hash. An empty table stays empty.
    """
    ws = Workspace(spark)
    docs, before = apart(docs)
    tie = F.xxhash64("text")
    per = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min(tie).alias("lo"), F.max(tie).alias("hi"))
    twice = ws.keep(per.where("n > 1").select("doc_id", (F.col("lo") != F.col("hi")).alias("several")), "twice")
    repeated = twice.limit(1).count() > 0
    if repeated:
        marked = docs.join(twice.withColumn("repeated", F.lit(True)), "doc_id", "left")
        own = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2).bitwiseOR(F.lit(1 << 62))
        marked = marked.withColumn("row:id", F.when(F.coalesce("several", F.lit(False)), own).otherwise(F.col("doc_id")))
        docs = ws.keep(marked.drop("several"), "named")
    else:
        docs = docs.withColumn("row:id", F.col("doc_id"))
    classes = ws.keep(parity_join.ParityJoin(docs.select(F.col("row:id").alias("doc_id"), "text")).classes(counted=False), "classes")
    spare = ws.keep(classes.where("doc_id <> component_id").select(F.col("doc_id").alias("row:id")).distinct(), "spare")
    kept = restrict(docs, spare, "row:id", "left_anti")
    if repeated:
        again = F.coalesce("repeated", F.lit(False)) & F.col("doc_id").isNotNull()
        kept = kept.where(~again).unionByName(kept.where(again).dropDuplicates(["row:id"]))
    return kept.select(*before)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which no benchmark item is covered by half or more.

    Null and empty texts stay, repeated rows are judged alike, and an empty benchmark removes nothing.
    """
    docs, before = apart(docs)
    return string_tiling.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*before)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it (0 to 3).

    Documents without words are never taken; a null source is a source of its own; repeated rows are taken alike.
    """
    docs, before = apart(docs)
    mixed = source_mix.mix(docs, keep=tuple(docs.columns))
    times = F.expr("cast(taken div greatest(size, 1) as int)")
    return mixed.select(*before, F.explode(F.array_repeat(F.lit(0), times)).alias("column:turn")).drop("column:turn")


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with shard and slot of a reproducible shuffle; input columns of these two names are replaced.

    Rows are numbered by doc_id (null first), then text; equal rows get neighbouring numbers.
    """
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    docs, before = apart(docs.select(*own))
    return feistel_shards.shard(docs, SHARDS).select(*before, "shard", "slot")


STAGES = [
    ("language_id", identify_language),
    ("parity_join", join_near_copies),
    ("string_tiling", decontaminate),
    ("source_mix", mix_sources),
    ("feistel_shards", deal_shards),
]

#: SQL can't express these stages; tests compare them and run() with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = ws.keep(stage(spark, docs, sf_dir), name)
        if k:
            ws.drop(STAGES[k - 1][0])
    return docs
