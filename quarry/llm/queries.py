"""The driver's queries for these operators, and their SQL where SQL expresses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import feistel_shards, language_id, paragraph_minhash, parity_join, quality_ledger, secret_ledger, source_mix, string_tiling, substring_dedup, token_pack

#: The vocabulary of op9; a file of the public tokenizers, at the path their package gives.
VOCABULARY = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.ParityJoin(table(spark, sf_dir, "documents")).classes()


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.SubstringDedup(table(spark, sf_dir, "documents")).rows()


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = feistel_shards.shard(docs, 24, text="text_crc32")
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~language_id.held_out()))
    return language_id.identify(docs.withColumn("held_out", language_id.held_out()), model, ("doc_id", "held_out"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = secret_ledger.BlobLedger(spark)
    return ledger.report(ledger.update(table(spark, sf_dir, "documents")))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return string_tiling.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_minhash.ParagraphDedup(table(spark, sf_dir, "documents")).rows().drop("kept")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_pack.pack_and_read(table(spark, sf_dir, "documents"), vocabulary()).drop("ids")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality_ledger.apply(quality_ledger.ledger(table(spark, sf_dir, "documents")), 2)
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


QUERIES = {
    "op1_parity_join": op1,
    "op2_substring_dedup": op2,
    "op3_feistel_shards": op3,
    "op4_language_id": op4,
    "op5_secret_ledger": op5,
    "op6_string_tiling": op6,
    "op7_paragraph_minhash": op7,
    "op8_source_mix": op8,
    "op9_token_pack": op9,
    "op10_quality_ledger": op10,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL = {
    "op10_quality_ledger": rf"""
with w as (
  select doc_id, coalesce(text, '') as t, {_WORDS} as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from documents),
wins as (select doc_id, w, t, l, list_transform(range(1, greatest(len(w) - 4, 0) + 1), lambda i: list_aggregate(w[i:i+4], 'string_agg', ' ')) as g from w),
u as (select doc_id, unnest(g) as g, generate_subscripts(g, 1) as i from wins),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from u) where c > 1),
p as (select distinct doc_id, unnest(range(i, i + 5)) as p from r),
n as (select doc_id, count(*) as n from p group by doc_id),
m as (
  select wins.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, len(l) as n_lines, coalesce(n.n, 0)::bigint as n_repeat_words
  from wins left join n using (doc_id)),
f as (select *, n_words < 10 as f0, 100 * n_repeat_words > 20 * n_words as f1, 10 * n_symbols > n_words as f2, 2 * n_dup_lines > n_lines as f3,
         n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words) as f4 from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f0 or f1 as base_failed, not (f0 or f1 or f2 or f3 or f4) as kept,
       (f0::int + 2 * f1::int + 4 * f2::int + 8 * f3::int + 16 * f4::int)::bigint as failed from f""",
}
