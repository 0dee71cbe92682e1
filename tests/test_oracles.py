"""Every query with SQL gives what DuckDB gives on the same tables."""

import glob
import os

import duckdb
import pytest

from strataloom import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def _rows(rows, names, order):
    shown = lambda v: "~" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(shown(r[names.index(c)]) for c in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equal(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    order = sorted(df.columns)
    found = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == order
    assert _rows([tuple(r) for r in df.collect()], df.columns, order) == _rows(found.fetchall(), names, order)


def test_every_oracle_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
