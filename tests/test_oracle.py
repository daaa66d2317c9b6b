"""Every query with SQL, at the smallest size, against DuckDB."""

import glob
import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from quarry import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.fixture(scope="module")
def found(spark, request):
    """Results of all queries that are to be tested, some at a time."""
    names = [i.callspec.params["name"] for i in request.session.items if i.fspath.basename == os.path.basename(__file__)]
    with ThreadPoolExecutor(6) as pool:
        yield {n: pool.submit(lambda n=n: queries.QUERIES[n](spark, SF).toPandas()) for n in names}


def _row(row: tuple) -> tuple:
    return tuple(None if v is None or v != v else float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v for v in row)


def _same(a, b) -> bool:
    """Rounded doubles may differ in their last place: sums come in another order."""
    return a == b or isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 1e-9 * max(abs(a), abs(b)) + 1.5e-7


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(found, con, name):
    got, want = found[name].result(), con.execute(queries.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    rows = [sorted((_row(r) for r in x[names].astype(object).values.tolist()), key=repr) for x in (got, want)]
    assert len(rows[0]) == len(rows[1])
    apart = [(a, b) for a, b in zip(*rows, strict=True) if not all(map(_same, a, b))]
    assert not apart, apart[:3]
