"""The llm queries that SQL can express give the same rows as DuckDB; the others run and keep their schema."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from scriptorium.llm import queries, sql


def canon(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_same_rows(spark, folder, name):
    duck = duckdb.connect()
    for p in glob.glob(folder + "/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    table = queries.queries()[name](spark, folder).toArrow()
    names = sorted(table.column_names)
    ours = sorted(tuple(map(canon, r)) for r in zip(*[table[n].to_pylist() for n in names]))
    cursor = duck.execute(sql.oracle_sql()[name])
    heads = [d[0] for d in cursor.description]
    order = [heads.index(n) for n in names]
    assert sorted(heads) == names and ours and ours == sorted(tuple(canon(r[i]) for i in order) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(sql.oracle_sql())))
def test_runs(spark, folder, name):
    df = queries.queries()[name](spark, folder)
    assert df.columns and df.count() >= 0
