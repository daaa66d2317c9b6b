"""The corpus operators against brute force on small tables with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import feistel_shards, language_id, paragraph_minhash, parity_join, quality_ledger, secret_ledger, source_mix, string_tiling, substring_dedup, token_pack
from quarry.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id long, size long, slot long, spans string"


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(60, 220))) for _ in range(25)]
    texts = [*base]
    for t in base[:12]:
        for n in (1, 3, 9):
            w = t.split()
            for _ in range(n):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            texts.append(" ".join(w))
    passage = " ".join(rnd.choice(words) for _ in range(70))
    texts += [f"{a}\n{passage}\n{b}" for a, b in zip(base[:8], base[8:16], strict=True)]
    texts += [base[0]] * 3 + [None, "", "  \n\t", "one", "Two Words", "a b c d", "a b c d e", "é" * 300, "x" * 700, "token = abcdef123456 é password:\"short\" secret=0123456789abcdef0123456789abcdef AKIA" + "A" * 16, "#### $$ %%", "same line here\nsame line here\nsame line here"]
    out = [(k, t, "en" if k % 2 else "de", None if k % 9 == 0 else f"s{k % 4}", 0, 7, 7, 7, "x") for k, t in enumerate(texts)]
    out += [out[0], (None, base[3], "en", "s1", 0, 7, 7, 7, "x"), (None, None, None, None, 0, 7, 7, 7, "x")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def _set(t):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in _words(t)]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_parity_join(docs, rows, none):
    ids = [r[0] for r in rows if r[0] is not None]
    sets = {r[0]: _set(r[1]) for r in rows if r[0] is not None}
    at = {i: i for i in ids}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((at[a], at[b]))
                at = {k: low if v == high else v for k, v in at.items()}
    got = parity_join.ParityJoin(docs).classes().collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == {(i, len(sets[i]), at[i]) for i in ids}
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert len(set(at.values())) < len(set(ids)) - 10
    assert parity_join.ParityJoin(none).classes().count() == 0


@pytest.mark.parametrize("block", [parity_join.BLOCK, 700])
def test_parity_join_counts_all_links(spark, docs, rows, block, monkeypatch):
    """n_links is the number of other texts (by their smallest ids) that a text is linked with."""
    monkeypatch.setattr(parity_join, "BLOCK", block)
    rnd = random.Random(8)
    base = [f"w{k}" for k in range(90)]
    more = [(1000 + k, " ".join(w if rnd.random() < 0.994 else f"x{k}-{j}" for j, w in enumerate(base))) for k in range(24)]
    more += [(1100, more[3][1]), (1005, more[9][1]), (1006, more[6][1]), (1007, " ".join([*base[:88], "one", "other"]))]
    some = [(r[0], r[1]) for r in rows] + more
    least = {}
    for i, t in some:
        if i is not None and _set(t):
            least[_set(t)] = min(i, least.get(_set(t), i))
    links = {i: set() for i in least.values()}
    for x, a in least.items():
        for y, b in least.items():
            if a != b and 100 * len(x & y) >= 80 * len(x | y):
                links[a].add(b)
    got = parity_join.ParityJoin(spark.createDataFrame(some, "doc_id long, text string")).classes().collect()
    want = Counter((i, len(_set(t)), len(links[least[_set(t)]]) if i is not None and _set(t) else 0) for i, t in some)
    assert Counter((r.doc_id, r.n_shingles, r.n_links) for r in got) == want
    assert max(map(len, links.values())) > 6


def test_parity_join_across_salts(spark, monkeypatch):
    """Sets that share only salted words, too far from the salts' smallest ids, and linked with each other."""
    monkeypatch.setattr(parity_join, "SHARE", 50)  # two salts for each
    stock = [f"w{k}" for k in range(404)]
    texts = [" ".join(stock + [f"u{i}-{k}" for k in range(90 if i < 60 else 49)]) for i in range(120)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in parity_join.ParityJoin(frame).classes().collect()}
    assert got == {i: min(i, 60) for i in range(120)}


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 400), min_size=1, max_size=120), st.sets(st.integers(0, 400), max_size=15), st.integers(0, 9))
def test_sketches_bound_differences(a, change, seed):
    x = np.unique(parity_join.mix(np.array(sorted(a), np.uint64) + np.uint64(seed)))
    y = np.unique(parity_join.mix(np.array(sorted(a ^ change or a), np.uint64) + np.uint64(seed)))
    assert parity_join.apart(parity_join.sketch(x), parity_join.sketch(y)) <= len(np.setxor1d(x, y))
    if parity_join.linked(len(np.intersect1d(x, y)), len(x), len(y), 80):
        small, large = sorted((x, y), key=len)
        band, most = parity_join.families(len(small), 80)[0]
        assert band in [f for f, _ in parity_join.families(len(large), 80)]
        w = parity_join.part_words(small, band, 80)
        if len(w) > most:
            assert np.isin(w, parity_join.part_words(large, band, 80)).any()


def _removed(texts, length):
    seen = Counter(b[s : s + length] for b in texts for s in range(len(b) - length + 1))
    for b in texts:
        covered = np.zeros(len(b) + 1, int)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                covered[s] += 1
                covered[s + length] -= 1
        yield np.cumsum(covered[:-1]) > 0


@pytest.mark.parametrize("group,hot,sent", [(substring_dedup.GROUP, substring_dedup.HOT, 9), (2, 3, substring_dedup.SENT), (substring_dedup.GROUP, 1, 0)])
def test_substring_dedup(docs, rows, none, group, hot, sent, monkeypatch):
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "SENT", sent)
    texts = [(r[1] or "").encode() for r in rows]
    want = Counter()
    for r, b, c in zip(rows, texts, _removed(texts, 200), strict=True):
        kept = bytes(np.frombuffer(b, np.uint8)[~c])
        want[(r[0], len(b), int(c.sum()), int((np.diff(c.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())] += 1
    assert Counter(map(tuple, substring_dedup.SubstringDedup(docs).rows().collect())) == want
    assert substring_dedup.SubstringDedup(none).rows().count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab", min_size=0, max_size=60), min_size=1, max_size=6), st.integers(2, 12))
def test_run_length_index(pieces, length):
    raw = [p.encode() for p in pieces]
    got = substring_dedup.repeated(raw, [0] * len(raw), length)
    seen = Counter(b[s : s + length] for b in raw for s in range(len(b) - length + 1))
    assert [g.tolist() for g in got] == [[s for s in range(len(b) - length + 1) if seen[b[s : s + length]] > 1] for b in raw]


def test_shards(docs, rows, none):
    got = feistel_shards.shard(docs, 5).select("doc_id", "shard", "slot", "row").collect()
    n = len(rows)
    assert sorted((r.slot, r.shard) for r in got) == sorted(divmod(p, 5) for p in range(n))
    for r in got:
        assert feistel_shards.row_of(np.array([r.shard]), np.array([r.slot]), n, 5)[0] == r.row
    again = feistel_shards.shard(docs.repartition(7), 5).select("doc_id", "shard", "slot", "row").collect()
    assert {tuple(r) for r in got if r.doc_id} == {tuple(r) for r in again if r.doc_id}
    assert feistel_shards.shard(none, 5).count() == 0
    assert sorted(feistel_shards.permute(np.arange(1000), 1000, 3)) == list(range(1000))


def test_language_id(spark, docs, none):
    texts = [("en" if k % 2 else "de", " ".join(random.Random(k).choices(["the", "and", "with", "this"] if k % 2 else ["der", "und", "nicht", "schon"], k=12))) for k in range(200)]
    train = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string")
    model = language_id.fit(train.where(~language_id.held_out()))
    got = {r.doc_id: r for r in language_id.identify(train, model).collect()}
    assert all(got[k].lang_pred == lang and got[k].score > 0.9 for k, (lang, _) in enumerate(texts))
    odd = language_id.identify(spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "the")], "doc_id long, text string"), model).collect()
    assert [(r.lang_pred, r.score > 0) for r in sorted(odd, key=lambda r: r.doc_id)] == [("und", False)] * 3 + [("en", True)]
    assert language_id.identify(docs, language_id.fit(none)).where("lang_pred <> 'und'").count() == 0
    bounded = language_id.fit(train, max_rows=50)
    assert bounded.langs == ["de", "en"]


def test_secret_ledger(spark, docs, rows, none):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
    want = Counter()
    for r in rows:
        t = r[1] or ""
        f = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        f += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        text = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(f))
        n = Counter(x[2] for x in f)
        want[(r[0], n["assign"], n["access"], n["hex"], hashlib.sha256(text.encode()).hexdigest(), text)] += 1
    ledger = secret_ledger.BlobLedger(spark)
    assert Counter(map(tuple, ledger.report(ledger.update(docs)).collect())) == want
    assert ledger.seen.count() == len({r[1] or "" for r in rows}) * len(secret_ledger.RULES)
    more = spark.createDataFrame([(900, "secret: abcdefgh"), (901, rows[0][1])], "doc_id long, text string")
    paths = ledger.update(more)  # one new blob; the other is known
    assert ledger.seen.count() == (len({r[1] or "" for r in rows}) + 1) * len(secret_ledger.RULES)
    assert {r.doc_id: r.spans for r in ledger.report(paths).collect()} == {900: "assign:0:16", 901: ""}
    assert secret_ledger.BlobLedger(spark).update(none).count() == 0


@pytest.mark.parametrize("few", [secret_ledger.FEW, 0])
def test_secret_ledger_many(spark, few, monkeypatch):
    """A text of thousands of spans, a blob of many rows, and a new version of a rule that scans known blobs again."""
    monkeypatch.setattr(secret_ledger, "FEW", few)
    long = "x token=abcdef1 \u00e9 " * 3000
    docs = spark.createDataFrame([(k, "secret: abcdefgh") for k in range(400)] + [(1000, long), (1001, None), (1001, "none")], "doc_id long, text string")
    ledger = secret_ledger.BlobLedger(spark)
    got = {(r.doc_id, r.n_assign): r.spans for r in ledger.report(ledger.update(docs)).collect()}
    at = [m.span() for m in re.finditer("token=abcdef1", long)]
    assert got[1000, 3000] == ",".join(f"assign:{a}:{b}" for a, b in at) and got[7, 1] == "assign:0:16" and got[1001, 0] == "" and len(got) == 402
    newer = (*secret_ledger.RULES[1:], secret_ledger.Rule("assign", "secret: [a-z]+", version=2))
    seen = ledger.seen.count()
    again = ledger.update(docs, newer)
    assert ledger.seen.count() == seen + 4 and ledger.seen.where("rule = 'assign@2'").count() == 4
    assert {r.spans for r in ledger.report(again, newer).where("doc_id < 400").collect()} == {"assign:0:16"}


def test_string_tiling(spark, docs, none):
    items = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "too short"), (3, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = items[0][1].split()
    texts = [(1, "x y " + items[0][1].upper() + " z"), (2, " ".join(words[6:] + ["q"] + words[:6])), (3, " ".join(words[:5])), (4, None), (5, "too short")]
    found = {(r.doc_id, r.item_id): r for r in string_tiling.leaks(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()}
    assert set(found) == {(1, 1), (2, 1), (5, 2)} and found[2, 1].n_tiles == 2 and found[1, 1].coverage == 1.0
    assert string_tiling.leaks(docs, bench).count() == 0 and string_tiling.clean(docs, bench).count() == docs.count()
    assert string_tiling.leaks(none, bench).count() == 0 and string_tiling.leaks(docs, bench.limit(0)).count() == 0


def _greedy(item, doc, least):
    """Greedy string tiling by definition: the longest free common run, first in the item, then in the document."""
    free, out = ([True] * len(item), [True] * len(doc)), []
    while True:
        best = (least - 1, 0, 0)
        for a in range(len(item)):
            for b in range(len(doc)):
                n = 0
                while a + n < len(item) and b + n < len(doc) and item[a + n] == doc[b + n] and free[0][a + n] and free[1][b + n]:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        if best[0] < least:
            return out
        out.append(best)
        for x, at in zip(free, best[1:], strict=True):
            x[at : at + best[0]] = [False] * best[0]


@pytest.mark.parametrize("pairs", [string_tiling.PAIRS, 3])
def test_tiling_brute(spark, pairs, monkeypatch):
    """Coverage, tiles and the longest one, over few words, so that seeds repeat; short items; both ways of searching."""
    monkeypatch.setattr(string_tiling, "PAIRS", pairs)
    rnd = random.Random(6)
    some = lambda n: [rnd.choice("ab") for _ in range(n)]
    items = [some(rnd.randrange(5, 18)) for _ in range(8)] + [["a"] * 9, ["b", "a"], [], ["a", "b", "a", "b"]]
    docs = [some(rnd.randrange(0, 40)) for _ in range(25)] + [["a"] * 50, ["b", "a"], ["a", "b", "a", "b"], items[0] + ["c"] + items[1]]
    want = set()
    for d, doc in enumerate(docs):
        for i, item in enumerate(items):
            made = _greedy(item, doc, 5) if len(item) >= 5 else [(len(item), 0, 0)] if item and item == doc else []
            if made and 2 * sum(x[0] for x in made) >= len(item):
                want.add((d, i, sum(x[0] for x in made) / len(item), len(made), max(x[0] for x in made)))
    frame = lambda rows, name: spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(rows)], f"{name} long, text string")
    got = string_tiling.leaks(frame(docs, "doc_id"), frame(items, "item_id"))
    assert {tuple(r) for r in got.collect()} == want and len(want) > 20
    assert {r.doc_id for r in string_tiling.clean(frame(docs, "doc_id"), frame(items, "item_id")).collect()} == set(range(len(docs))) - {w[0] for w in want}


def test_tiling_long_text(spark):
    """A text of a million equal words against an item of them."""
    bench = spark.createDataFrame([(1, "spam " * 100)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "spam " * 1_000_000), (2, None)], "doc_id long, text string")
    assert [(r.doc_id, r.coverage, r.n_tiles) for r in string_tiling.leaks(docs, bench).collect()] == [(1, 1.0, 1)]


def test_paragraph_minhash(docs, rows, none):
    got = {r.doc_id: r for r in paragraph_minhash.ParagraphDedup(docs).rows().collect() if r.doc_id is not None}
    carry = [r[0] for r in rows if r[1] and r[0] is not None and r[1].count("\n") == 2 and len(r[1]) > 900]
    assert len(carry) == 8 and all(k in got for k in carry)
    assert sum(got[k].n_removed for k in carry) >= 7
    assert paragraph_minhash.ParagraphDedup(none).rows().count() == 0
    bands, size = paragraph_minhash.tune()
    assert 1 - (1 - 0.8**size) ** bands >= 0.99


def test_repeated_passages(spark):
    """Each passage of 50 words repeats: in long lines without stops, in lines of 60 words, over short lines; short lines as wholes."""
    rnd = random.Random(17)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(7))
    some = lambda n: [word() for _ in range(n)]
    texts, lost = [], {}
    for k in range(24):
        p = some(50)
        for turn in range(2):
            if k % 3 == 0:
                w = [*some(45), *p, *some(45)]
            elif k % 3 == 1:
                w = [*some(4 + turn), *p, *some(6 - turn)]
            else:
                w = [*p, *some(3)]
                w = [x + ("\n" if j % (4 + turn) == 3 else "") for j, x in enumerate(w)]
            texts.append(" ".join(w))
            if turn:
                lost[len(texts) - 1] = p
    texts += [f"{' '.join(some(30))}\n{line}\n{' '.join(some(30))}" for line in [" ".join(some(6))] for _ in range(2)]
    lost[len(texts) - 1] = texts[-1].split("\n")[1].split()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept).decode() for r in paragraph_minhash.ParagraphDedup(frame).rows().collect()}
    for k, t in enumerate(texts):
        gone = Counter(_words(t)) - Counter(_words(got.get(k, t)))
        assert set(gone) <= set(lost.get(k, ())), k
        assert k not in lost or sum(gone.values()) >= min(20, len(lost[k])), k
    assert got == {r.doc_id: bytes(r.kept).decode() for r in paragraph_minhash.ParagraphDedup(frame.repartition(7)).rows().collect()}


def test_anchored_runs():
    """A passage of 50 words has a run in common wherever it stands, and a text's runs don't depend on the texts around it."""
    rnd = random.Random(2)
    some = lambda n: [str(rnd.randrange(10**6)) for _ in range(n)]

    def runs(*texts):
        words = paragraph_minhash.Words([" ".join(t).encode() for t in texts])
        text = np.searchsorted(words.first, np.arange(len(words)), "right") - 1
        at, uid = paragraph_minhash.anchored(words, text, text)
        return [set(uid[text[at] == k].tolist()) for k in range(len(texts))]

    for _ in range(300):
        p = some(50)
        x, y = some(rnd.randrange(30)) + p + some(rnd.randrange(30)), some(rnd.randrange(30)) + p + some(rnd.randrange(30))
        both = runs(x, [], y)
        assert both[0] & both[2] and both[0] == runs(x)[0] and both[2] == runs(y, x)[0]
    assert runs(["a"] * 19, ["a"] * 19) == [set(), set()]


@pytest.mark.parametrize("block", [paragraph_minhash.BLOCK, 300])
def test_paragraph_clusters(spark, block, monkeypatch):
    """Chains of near copies, whose ends are far apart: clusters are the components of all links between sets."""
    met = []
    arms = paragraph_minhash.ParagraphDedup._arms
    monkeypatch.setattr(paragraph_minhash.ParagraphDedup, "_arms", lambda self, members: met.append(1) or arms(self, members))
    monkeypatch.setattr(paragraph_minhash, "BLOCK", block)
    rnd = random.Random(11)
    texts = []
    for _ in range(4):
        w = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(58)]
        for _ in range(30):
            w[rnd.randrange(len(w))] = "".join(rnd.choice("abcdefgh") for _ in range(6))
            texts.append(" ".join(w))
    sets = [_set(t) for t in texts]
    at = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if at[a] != at[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                at = [at[b] if v == at[a] else v for v in at]
    order = list(range(len(texts)))
    rnd.shuffle(order)
    frame = spark.createDataFrame([(k, texts[k]) for k in order], "doc_id long, text string")
    got = {r.rid: r.cluster for r in (lambda u, c: u.join(c, "uid", "left").select("rid", F.coalesce("cluster", "uid").alias("cluster")).collect())(*paragraph_minhash.ParagraphDedup(frame).clusters())}
    assert met
    pairs = [(a, b) for a in range(len(texts)) for b in range(a)]
    assert [at[a] == at[b] for a, b in pairs] == [got[a] == got[b] for a, b in pairs]
    assert len(set(at)) < 20


def test_near_arms_nearest(spark):
    """Asked for the nearest only, a set names one of its near partners, and one that is as near as any."""
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(60)]
    sets = {k: np.unique(np.array([*base[k % 7 :], *(rnd.getrandbits(64) for _ in range(k % 5))], np.uint64)) for k in range(1, 25)}
    frame = spark.createDataFrame([(k, len(s), bytearray(parity_join.sketch(s).tobytes())) for k, s in sets.items()], "id long, n long, sketch binary")
    members = spark.createDataFrame([(0, k, k) for k in sets], "a long, b long, component long")
    every = {(r.a, r.b) for r in parity_join.near_arms(members, frame, 80).collect()}
    some = {(r.a, r.b) for r in parity_join.near_arms(members, frame, 80, True).collect()}
    assert {(a, b) for a in sets for b in sets if a < b and parity_join.linked(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]), 80)} <= every
    assert some and some <= every and len(some) < len(sets)


def test_source_mix(docs, rows, none):
    got = source_mix.mix(docs).collect()
    assert len(got) == len(rows) and all(r.taken % max(1, r["size"]) == 0 and r.taken <= 3 * r["size"] for r in got)
    assert Counter(map(tuple, got)) == Counter(map(tuple, source_mix.mix(docs.repartition(5)).collect()))
    assert sum({r.source_size: r.target for r in got}.values()) == pytest.approx(sum(len(_words(r[1])) for r in rows))
    assert source_mix.targets([10, 100, 100], [5, 2, 1]) == pytest.approx([30, 120, 60])
    assert source_mix.mix(none).count() == 0
    flow = source_mix.min_cost_flow([(0,), (0, 1), (1,)], [10, 10, 10], [15, 30])
    assert sum(f.get(0, 0) for f in flow) == 15 and sum(f.get(1, 0) for f in flow) == 30


def test_token_pack(docs, rows, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    got = token_pack.pack_and_read(docs, vocabulary()).orderBy("start").collect()
    want = Counter((r[0], tuple(tok.encode(r[1] or "", add_special_tokens=False).ids + [1])) for r in rows)
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at and r.ids_crc32 == zlib.crc32(r.ids)
        at += r.n_tokens
    keys = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(keys)
    assert token_pack.pack_and_read(none, vocabulary()).count() == 0


@pytest.mark.parametrize("hash_", [None, lambda x: x % np.uint64(5)])
def test_word_cache(hash_, monkeypatch):
    """Ids of pieces put together are the tokenizer's of the whole text: stops, cases, combining marks, long words, equal hashes."""
    from tokenizers import Tokenizer

    if hash_:
        monkeypatch.setattr(token_pack, "mix", hash_)
    rnd = random.Random(4)
    odd = ["J\u030c", "\u0301a", "K\u212a", "\u00c9t\u00e9.", "3.", "...", "a..", "\u00d7.", "\u00bb.", "don't.", "'s!", ".'s", "x" * 16, "x" * 17 + ".", "y" * 300, "\x01", "a\x01b", "\0", "a\0", "a", "A", "\u4e2d\u6587.", "\u3000.", "a\u00a0b,", "STRASSE\u1e9e", "\u03a3\u03a3.", "", "<|endoftext|>", "<|EndOfText|>", "I'M", "x'Re?"]
    texts = [" ".join(rnd.choice(odd) + rnd.choice(["", "", "q", "Q.", "\n"]) for _ in range(rnd.randrange(40))) for _ in range(300)]
    tok = Tokenizer.from_file(vocabulary())
    cache = token_pack.WordCache(tok, 1, most=200)
    for k in range(0, 300, 30):
        ids, sizes = cache.encode([t.encode() for t in texts[k : k + 30]])
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [[*tok.encode(t, add_special_tokens=False).ids, 1] for t in texts[k : k + 30]]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 300), st.integers(0, 2**20), st.integers(0, 2**64 - 1)), max_size=700))
def test_simple8b(ids):
    x = np.array(ids, np.uint64)
    words, offsets, at, values = token_pack.encode(x)
    assert (token_pack.decode(words, offsets, len(x), at, values) == x).all()


def test_quality_ledger(docs, rows, none):
    got = quality_ledger.apply(quality_ledger.ledger(docs), 2)
    want = Counter()
    for r in rows:
        t, w = r[1] or "", _words(r[1])
        g = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        p = {k + j for k in range(len(w) - 4) if g[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if _words(x)]
        want[(r[0], len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(p), len(w) < 10 or 100 * len(p) > 20 * len(w))] += 1
    assert Counter(map(tuple, got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())) == want
    table = {r.rule: r for r in quality_ledger.ablation(got, 2).collect()}
    assert table["short"].n_failed == got.where("n_words < 10").count()
    assert quality_ledger.ledger(none).count() == 0
