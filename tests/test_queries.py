import glob
import os

import duckdb
import pytest

from lakeloom.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def plain(rows):
    return sorted((tuple(round(v, 4) if isinstance(v, float) else str(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_equals_its_sql(spark, db, name):
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    out = db.execute(queries.ORACLES[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == cols
    assert plain(tuple(r[c] for c in cols) for r in got.collect()) == plain(tuple(dict(zip(names, r, strict=True))[c] for c in cols) for r in out.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
