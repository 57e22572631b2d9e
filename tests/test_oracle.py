"""Every query with SQL gives the same rows as DuckDB at the smallest scale."""

from pathlib import Path

import duckdb
import pytest

from framelark.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for f in Path(SF).iterdir():
        db.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return db


def plain(v):
    return None if v is None or v != v else round(float(v), 5) + 0.0 if isinstance(v, float) else float(v) if isinstance(v, int) and not isinstance(v, bool) else str(v) if not isinstance(v, (bool, str)) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.SQL[name])
    mine, theirs = rows(got.columns, got.collect()), rows(want.columns, want.fetchall())
    assert mine[0] == theirs[0] and len(mine[1]) == len(theirs[1])
    for a, b in zip(mine[1], theirs[1]):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and x == pytest.approx(y, rel=1e-6, abs=2e-5)) for x, y in zip(a, b)), (a, b)
