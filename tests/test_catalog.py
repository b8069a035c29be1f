"""Every query with SQL gives DuckDB's rows; the others run."""

import math

import duckdb
import pytest

from sketchloom import catalog, catalog_engine, catalog_files  # noqa: F401 (they register their queries)

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def norm(rows):
    f = lambda v: round(v, 6) if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(map(f, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    got = df.collect()
    if name in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[name])
        assert sorted(df.columns) == sorted(want.columns)
        order = [want.columns.index(c) for c in df.columns]
        assert norm(got) == norm(tuple(r[i] for i in order) for r in want.fetchall())
    else:
        assert got
