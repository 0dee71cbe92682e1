"""Queries on pages whose lines open with numbers, and on components between two integers, give what their SQL gives."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from strataloom import registry

PAGES = [
    "<h2>1 The title</h2><p>4703443633947811 Auf der Bank</p><p>2.1 and the rest</p>",
    "<p>1. und les deux</p><h3>2 Les deux</h3><p>3、the end</p>",
    "<p>1 der Anfang</p><p>plain</p><p>2 und Ende</p>",
]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder = tmp_path_factory.mktemp("marked")
    pq.write_table(pa.table({"page_id": pa.array(range(len(PAGES)), pa.int64()), "url": ["u"] * len(PAGES), "html": PAGES}), folder / "pages.parquet")
    halves = ((np.arange(-400, 400) + 0.5) / 1000).astype(np.float32).reshape(-1, 8)
    pq.write_table(pa.table({"vec_id": pa.array(range(len(halves)), pa.int64()), "embedding": pa.array(halves.tolist(), pa.list_(pa.float32())), "label": pa.array([1] * len(halves), pa.int32())}), folder / "embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", ["alias_candidates", "best_section", "section_span", "mime_blocks", "box_bounds"])
def test_equal(spark, tables, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables}/{t}.parquet')")
    df = registry.QUERIES[name](spark, str(tables))
    wanted = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in wanted.description]
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(wanted.fetchall(), key=repr)
