"""The pipeline's stages on small tables, against versions by definition."""

import math
import random
from collections import Counter

import corpus_pipeline
import pytest

from quarry.llm import language_id

from .test_operators import _greedy, _set, _words

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double, size long, row long, _ string, shard string"
STAGE = dict(corpus_pipeline.STAGES)


def _frame(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (4 - len(r)), 0, "x", 1.5, 7, 8, "y", "z") for r in rows], SCHEMA)


def _ids(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        if name != "feistel_shards":
            assert out.columns == docs.columns
        if name != "source_mix":
            assert out.count() <= n
        docs, n = out, out.count()
    assert n > 100 and sorted(r.slot for r in docs.where("shard = 0").collect()) == list(range(docs.where("shard = 0").count()))


@pytest.mark.parametrize("name", list(STAGE))
def test_odd_tables(spark, name):
    """Empty tables, nulls in all columns, repeated rows and clashing names."""
    none = spark.createDataFrame([], SCHEMA)
    out = STAGE[name](spark, none, SF)
    want = [c for c in none.columns if c != "shard"] + ["shard", "slot"] if name == "feistel_shards" else none.columns
    assert out.columns == want and out.count() == 0
    rows = [(None, None), (1, None), (2, ""), (3, "the first words of this text are these"), (3, "the first words of this text are these"), (None, "the first words of this text are these")]
    out = STAGE[name](spark, _frame(spark, rows), SF)
    assert out.columns == want
    for r in out.collect():
        assert (r["_"], r["size"], r["row"], r["lang_pred"], r["score"]) == ("y", 7, 8, "x", 1.5)


def test_near_copies_of_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (7, c), (7, "A zz B"), (8, c + " more"), (8, None), (9, c), (9, c)]
    assert _ids(STAGE["parity_join"](spark, _frame(spark, rows), SF)) == sorted([(3, a), (5, b), (7, "A zz B"), (8, None), (9, c)], key=repr)


def _near(rows):
    """One row of each component of near copies: the smallest id."""
    sets = [_set(t) for _, t in rows]
    at = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            if at[x] != at[y] and sets[x] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                at = [at[y] if v == at[x] else v for v in at]
    best = {}
    for (i, _), comp in zip(rows, at, strict=True):
        best[comp] = min(best.get(comp, i), i)
    return sorted(((i, t) for (i, t), comp in zip(rows, at, strict=True) if best[comp] == i), key=repr)


def test_run(spark, tmp_path):
    """run() against its stages by definition."""
    rnd = random.Random(12)
    vocabulary = {x: ["".join(rnd.choice(y) for _ in range(6)) for _ in range(60)] for x, y in (("en", "abcdefgh"), ("de", "mnopqrst"))}
    some = lambda lang, n: [rnd.choice(vocabulary[lang]) for _ in range(n)]
    item = [some("en", 14), some("de", 12)]
    texts = []
    for k in range(60):
        w = some("en" if k % 3 else "de", rnd.randrange(20, 90))
        texts.append(w)
        if k % 4 == 0:
            near = list(w)
            near[rnd.randrange(len(near))] = "changed"
            texts.append(near)
        if k % 7 == 0:
            texts.append(w[:5] + item[k % 2] + w[5:])
    rows = [(k, " ".join(w), "de" if w[0] in vocabulary["de"] else "en", f"s{k % 3}", 0) for k, w in enumerate(texts)]
    rows += [(500, None, "en", "s1", 0), (501, "...", "en", "s1", 0)]
    rnd.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = language_id.fit(docs.where(~language_id.held_out()))

    def sure(text):
        """The posterior by sums over the text's own n-grams."""
        t = text.lower()
        grams = [int(x) for n in (2, 3) for x in language_id.features([t])[0][n - 2][: len(t)]]
        scores = [model.prior[k] + sum(float(model.logp[k][g]) for g in grams) for k in range(len(model.langs))]
        return 1 / sum(math.exp(s - max(scores)) for s in scores)

    kept = [(i, t) for i, t, *_ in rows if t and any(map(str.isalpha, t)) and sure(t) >= corpus_pipeline.SURE]
    kept = _near(kept)
    kept = [(i, t) for i, t in kept if not any(2 * sum(x[0] for x in _greedy(w, t.split(), 5)) >= len(w) for w in item)]
    source = {r[0]: r[3] for r in rows}
    size, names = Counter(), sorted({source[i] for i, _ in kept})
    for i, t in kept:
        size[source[i]] += len(_words(t))
    weight = dict(zip(names, (5, 2, 1), strict=True))
    goal, left, open_ = {}, sum(size.values()), set(names)
    while open_:
        full = {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) >= 3 * size[s]}
        goal |= {s: 3 * size[s] if s in full else left * weight[s] / sum(weight[x] for x in open_) for s in (full or open_)}
        left, open_ = (left - sum(3 * size[s] for s in full), open_ - full) if full else (0, set())
    times, text = Counter(r.doc_id for r in got), dict(kept)
    assert set(times) <= set(text) and max(times.values()) <= 3 and {(r.doc_id, r.text) for r in got} <= set(kept)
    for s in names:
        mine = [i for i, _ in kept if source[i] == s]
        taken = sum(times[i] * len(_words(text[i])) for i in mine)
        assert abs(taken - goal[s]) <= max(len(_words(text[i])) for i in mine)
        assert max(times[i] for i in mine) - min(times[i] for i in mine) <= 1  # convex costs: no third time before all have a second
    assert sorted((r.slot, r.shard) for r in got) == sorted(divmod(p, corpus_pipeline.SHARDS) for p in range(len(got)))
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(map(tuple, got)) == Counter(map(tuple, again.collect()))


def test_language_by_definition(spark):
    """Counts, smoothing, priors and posteriors of the classifier, by plain sums."""
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("the cat", "en"), ("THE dog!", "en"), ("der Hund", "de"), ("", "de"), ("\u00e9t\u00e9 \U0001f600", "fr")])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(frame)
    assert model.langs == ["de", "en", "fr"]
    gram = lambda t: [int(x) for n in (0, 1) for x in language_id.features([t.lower()])[0][n][: len(t.lower())]]
    counts = {lang: Counter(g for _, t, x in rows if x == lang for g in gram(t)) for lang in model.langs}
    test = [(10, "the dog"), (11, "d"), (12, "Hund der \u00e9t\u00e9")]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(test, "doc_id long, text string"), model).collect()}
    for i, t in test:
        score = {}
        for lang in model.langs:
            total = sum(counts[lang].values()) + 0.5 * language_id.BUCKETS
            score[lang] = math.log(sum(x == lang for *_, x in rows) / len(rows)) + sum(math.log((counts[lang][g] + 0.5) / total) for g in gram(t))
        best = max(score, key=score.get)
        assert got[i].lang_pred == best
        assert got[i].score == pytest.approx(1 / sum(math.exp(s - score[best]) for s in score.values()), abs=1e-4)
    clash = spark.createDataFrame([(1, "the dog", "q", 2.0)], "doc_id long, text string, lang_pred string, score double")
    assert language_id.identify(clash, model, ("doc_id", "lang_pred", "score")).columns == ["doc_id", "lang_pred", "score"]
    assert docs_of(spark, model) == ["und"]


def docs_of(spark, model):
    return [r.lang_pred for r in language_id.identify(spark.createDataFrame([(1, "1" * 300_000)], "doc_id long, text string"), model).collect()]
