"""Quality rules as a ledger of failure bits.

Every rule is evaluated once for each text; the ledger row keeps the measurements and a bit for each rule
that failed. A policy is a versioned mask of rules: applying one, or finding what each rule alone removes
(ablation), is bit arithmetic over the ledger and reads no text again. DataFrame functions only; nothing
is shuffled but the sums of an ablation.

Measurements: words ``[^\\x20\\x09-\\x0D]+``; ``word_chars`` code points in words; ``n_symbols`` characters of
``#*$%&|<>``; ``n_dup_lines`` lines with a word that equal an earlier line; ``n_repeat_words`` words in
5-word windows that occur twice or more in the text, compared by 64-bit hashes.

Edge cases: null text has no words and fails ``short``; other columns are ignored; repeated rows repeat;
an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeats(words: Column) -> Column:
    """Words that stand in a window that occurs twice or more."""
    last = F.size(words) - WINDOW

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))

    def covered(h: Column) -> Column:
        order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            at = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
            return F.array_sort(F.transform(at, lambda x: x["i"]))

        def total(at: Column) -> Column:
            return F.aggregate(F.transform(at, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - i, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)

        return _let(order, lambda s: _let(twice(s), total))

    dealt = _let(words, lambda w: _let(windows(w), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0))))
    return F.when(last >= 1, dealt).otherwise(F.lit(0))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    made = F.struct(
        F.size(words).alias("n_words"),
        F.length(F.translate(text, SPACES, "")).alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
        _let(lines, F.size).alias("n_lines"),
        _let(words, _repeats).alias("n_repeat_words"),
    )
    return docs.select("doc_id", made.alias("_m")).select("doc_id", *(F.col(f"_m.{c}").cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")))


@dataclass(frozen=True)
class Rule:
    name: str
    fails: str  # an expression over the measurements


#: The order gives the bits; rules are only ever appended, so that old ledgers stay valid.
RULES = (
    Rule("short", "n_words < 10"),
    Rule("repeated", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("dup_lines", "2 * n_dup_lines > n_lines"),
    Rule("word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)"),
)
#: Versions of the policy: names of rules.
POLICIES = {1: ("short", "repeated"), 2: tuple(r.name for r in RULES)}
BASE = POLICIES[1]


def mask(names: tuple[str, ...]) -> int:
    return sum(1 << k for k, r in enumerate(RULES) if r.name in names)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, measurements and ``failed``, the bits of the rules that a text fails."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << k)).otherwise(F.lit(0)) for k, r in enumerate(RULES)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measure(docs).withColumn("failed", failed.cast("long"))


def apply(entries: DataFrame, policy: int) -> DataFrame:
    """entries with ``base_failed`` and ``kept`` under a version of the policy."""
    names = POLICIES[policy]
    return entries.withColumns({
        "base_failed": F.col("failed").bitwiseAND(F.lit(mask(BASE)).cast("long")) != 0,
        "kept": F.col("failed").bitwiseAND(F.lit(mask(names + BASE)).cast("long")) == 0,
    })


def ablation(entries: DataFrame, policy: int) -> DataFrame:
    """For each rule of a policy: rows that fail it, that fail it alone, and that the policy without it would keep."""
    of = F.lit(mask(POLICIES[policy])).cast("long")
    sums = entries.select(F.col("failed").bitwiseAND(of).alias("f")).groupBy("f").agg(F.count("*").alias("n"))  # 2**rules rows at most
    rules = [(k, r.name) for k, r in enumerate(RULES) if r.name in POLICIES[policy]]
    bit = [F.lit(1 << k).cast("long") for k, _ in rules]
    rows = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), (F.col("f").bitwiseAND(b) != 0).alias("fails"), (F.col("f") == b).alias("alone")) for b, (_, name) in zip(bit, rules, strict=True))))
    x = sums.select("f", "n", rows.alias("r"))
    return x.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("r.fails"), F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("r.alone"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(F.col("r.alone") | (F.col("f") == 0), F.col("n")).otherwise(0)).alias("n_kept_without"),
    )
