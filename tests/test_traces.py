"""Lines of descent against brute force, over deep chains, gaps, cycles and repeated rows."""

import random

import pytest

from quarry.operators.traces import TraceEngine

COLUMNS = "trace_id string, span_id string, parent_span_id string, name string"


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    out = [("deep", str(k), str(k - 1) if k else None, "b" if k % 69 else "a") for k in range(70)]
    for t in range(12):
        for k in range(25):
            out.append((f"t{t}", str(k), str(rnd.randrange(k)) if k and rnd.random() < 0.95 else None, rnd.choice("aabbc")))
    out += [("lost", "1", "0", "b"), ("lost", "2", "1", "a"), ("self", "1", "1", "a"), ("self", "2", "1", "b"), ("ring", "1", "2", "a"), ("ring", "2", "1", "b"), out[75]]
    return out


def _above(rows, within):
    """For each span of within the spans above it, by a line through within."""
    parent = {(t, s): (t, p) for t, s, p, _ in rows if p is not None and p != s}
    for at in within:
        seen, up = set(), parent.get(at)
        while up in within and up not in seen:
            seen.add(up)
            up = parent.get(up)
        yield at, seen


@pytest.mark.parametrize("op,names", [(">>", "ab"), ("<<", "bc"), ("!>>", "bb"), ("&<<", "ab")])
def test_lines(spark, rows, op, names):
    spans = spark.createDataFrame(rows, COLUMNS)
    of = [{(t, s) for t, s, _, n in rows if n == name} for name in names]
    above = dict(_above(rows, of[0] | of[1]))
    pairs = [(x, y) for y, ups in above.items() for x in ups]
    pairs = {(x, y) for x, y in (pairs if ">" in op else [(y, x) for x, y in pairs]) if x in of[0] and y in of[1]}
    met = {y for _, y in pairs}
    want = of[1] - met if op[0] == "!" else met | {x for x, _ in pairs} if op[0] == "&" else met
    got = TraceEngine(spans).select(f'{{ name = "{names[0]}" }} {op} {{ name = "{names[1]}" }}')
    assert {(r.trace_id, r.span_id) for r in got.collect()} == want
