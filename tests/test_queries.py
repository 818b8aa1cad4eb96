"""Every registered fixture query against its SQL in DuckDB."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cairn.plans import fixture_queries as q

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return f"{v + 0.0:.5f}"
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_same_as_sql(spark, con, name):
    df = q.QUERIES[name](spark, D)
    cur = con.execute(q.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted(tuple(shown(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall())
    got = sorted(tuple(shown(r[c]) for c in sorted(names)) for r in df.collect())
    assert got == want


def test_preset_labels_beside_the_thresholds(spark, tmp_path):
    at = np.array([84, 37.5, 56]).astype(np.float32) / np.float32(600)
    values = np.concatenate([at, np.nextafter(at, np.float32(1)), np.nextafter(at, np.float32(0)), np.zeros(55, np.float32)])
    table = pa.table({"vec_id": [1, 2], "embedding": pa.array([values.tolist(), values[::-1].tolist()], pa.list_(pa.float32()))})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = sorted(map(tuple, c.execute(q.ORACLES["preset_labels"]).fetchall()))
    assert sorted(map(tuple, q.QUERIES["preset_labels"](spark, str(tmp_path)).collect())) == want


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLES)))
def test_runs(spark, name):
    assert q.QUERIES[name](spark, D).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(q.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
