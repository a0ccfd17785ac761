"""Every query with SQL gives the same rows as DuckDB; the others run and keep their schema."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from scriptorium.plans import catalog


def canon(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(canon, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck(folder):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in glob.glob(folder + "/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows(spark, folder, duck, name):
    table = catalog.QUERIES[name](spark, folder).toArrow()
    names = sorted(table.column_names)
    ours = sorted(tuple(map(canon, r)) for r in zip(*[table[n].to_pylist() for n in names]))
    cursor = duck.execute(catalog.SQL[name])
    theirs_names = [d[0] for d in cursor.description]
    assert sorted(theirs_names) == names
    order = [theirs_names.index(n) for n in names]
    assert ours == sorted(tuple(canon(r[i]) for i in order) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, folder, name):
    df = catalog.QUERIES[name](spark, folder)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    if os.path.isdir("/root/testdata/sf0.001"):
        assert __spark_entry__.entry(spark).count() == 1
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
