"""Secret scanning over an incremental ledger of blobs.

Every text is content-addressed (SHA-256 of its UTF-8 bytes). The ledger holds, for each rule version, the
blobs that were scanned and the spans found in them. A scan takes only the pairs of blob and rule version
that the ledger has not seen; findings are joined back to every path (document) and every historical
version that has the blob. DataFrame functions only.

Spans are code point offsets, end exclusive. A rule is a pattern and a least length of one of its groups;
matches are leftmost and do not overlap; one that fails its length is dropped but still used up. Offsets
come from the lengths of matches and of the pieces between them.

A blob of very many rows is no task of its own: blobs with findings, and those with several rows, go to every
executor if they are counted and few; else the joins are shuffled and their skewed sides split at run time.

Edge cases: null text is the empty text. Rows with equal doc_id are separate paths. Repeated rows repeat
their findings. An empty table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, restrict


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base patterns of the contract. Maximal runs of a least length need no second test.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Further kinds, which add spans.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE + MORE
#: Spans gathered in one array before it is put to the others.
TOGETHER = 256
#: Blobs and spans that are sent to every executor at most; about 100 bytes each.
FEW = 300_000
SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """The spans of a rule in a text."""
    pattern = F.lit(rule.pattern)

    def walk(between: Column, found: Column, values: Column) -> Column:
        none = F.array().cast(SPANS)

        def step(acc: Column, k: Column) -> Column:
            start = acc["at"] + F.length(F.get(between, k))
            end = start + F.length(F.get(found, k))
            one = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
            good = F.length(F.get(values, k)) >= rule.least
            return F.struct(end.alias("at"), F.when(good, F.concat(acc["all"], F.array(one))).otherwise(acc["all"]).alias("all"))

        def block(acc: Column, k: Column) -> Column:
            """Arrays grow by copies: spans are gathered in blocks, so a text of very many stays near linear."""
            own = F.aggregate(F.sequence(k, F.least(k + TOGETHER, F.size(found)) - 1), F.struct(acc["at"].alias("at"), none.alias("all")), step)
            return F.struct(own["at"].alias("at"), F.concat(acc["all"], F.array(own["all"])).alias("all"))

        begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("all"))
        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1, F.lit(TOGETHER)), begin, block, lambda acc: F.flatten(acc["all"]))

    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    parts = F.array(F.struct(F.split(text, rule.pattern).alias("between"), whole.alias("found"), value.alias("values")))
    at = F.get(F.transform(parts, lambda p: walk(p["between"], p["found"], p["values"])), F.lit(0))
    return F.when(F.rlike(text, pattern), at).otherwise(F.array().cast(SPANS))


def written(all_spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(all_spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


class BlobLedger:
    """A ledger in a folder of the store: ``seen`` (blob, rule) and ``findings`` (blob, rule, spans)."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.ws = spark, Workspace(spark)
        self.path = path or f"{self.ws.path}/ledger"

    def _table(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], schema)

    @property
    def seen(self) -> DataFrame:
        return self._table("seen", "blob binary, rule string")

    @property
    def findings(self) -> DataFrame:
        return self._table("findings", f"blob binary, rule string, spans {SPANS}")

    def update(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scans what is new in docs; returns (doc_id, blob) of all its rows."""
        rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        blob = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
        paths = self.ws.keep(rows.select("doc_id", blob.alias("blob")), "paths")
        new = self.ws.keep(self._unseen(paths, rules), "new")
        one = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
        many = self.ws.keep(one.where("n > 1").select("blob", F.col("doc_id").alias("first")), "many")
        spare = paths.join(F.broadcast(many) if many.count() <= FEW else many, "blob").where("doc_id <> first or (doc_id is null and first is not null)")
        spare = self.ws.keep(spare.select("doc_id", "blob").distinct(), "spare")
        todo = self._without(rows.withColumn("blob", blob), spare)
        for names in [r["rules"] for r in new.select("rules").distinct().collect()]:  # sets of rules, of which there are few
            own = [r for r in rules if r.name in names]
            batch = todo
            if len(names) < len(rules) or self.seen.limit(1).count():
                batch = todo.join(new.where(F.col("rules") == F.array(*map(F.lit, names))).select("blob"), "blob", "left_semi")
            ranks = {r: k for k, r in enumerate(rules)}
            found = F.map_from_arrays(F.array(*(F.lit(r.name) for r in own)), F.array(*(spans(F.col("text"), r, ranks[r]) for r in own)))
            some = batch.select("blob", F.explode(found).alias("rule", "spans")).where("size(spans) > 0").dropDuplicates(["blob", "rule"])
            some.write.mode("append").parquet(f"{self.path}/findings")
        new.select("blob", F.explode("rules").alias("rule")).write.mode("append").parquet(f"{self.path}/seen")
        return paths

    def _unseen(self, paths: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
        """(blob, rules) with the rules that have not scanned a blob."""
        names = F.array(*(F.lit(r.name) for r in rules))
        blobs = paths.select("blob").distinct()
        done = self.seen.where(F.col("rule").isin([r.name for r in rules])).groupBy("blob").agg(F.collect_set("rule").alias("done"))
        left = blobs.join(done, "blob", "left").select("blob", F.array_except(names, F.coalesce("done", F.array().cast("array<string>"))).alias("rules"))
        return left.where("size(rules) > 0")

    def _without(self, rows: DataFrame, spare: DataFrame) -> DataFrame:
        known, none = rows.where("doc_id is not null"), rows.where("doc_id is null")
        kept = restrict(known, spare.where("doc_id is not null"), ["doc_id", "blob"], "left_anti")
        return kept.unionByName(none)

    def report(self, paths: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> DataFrame:
        """For each path its counts, digest and spans."""
        found = self.findings.where(F.col("rule").isin([r.name for r in rules]))
        per = self.ws.keep(found.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans")), "spans")
        n, held = per.agg(F.count("*"), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
        all_ = F.coalesce("spans", F.array().cast(SPANS))
        kinds = [r.kind for r in base]
        out = paths.join(F.broadcast(per) if n + held <= FEW else per, "blob", "left").withColumn("spans", all_)
        counts = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{k}") for k in kinds]
        digest = F.sha2(written(F.filter("spans", lambda s: s["kind"].isin(kinds))), 256)
        return out.select("doc_id", *counts, digest.alias("base_sha256"), written(F.col("spans")).alias("spans"))
