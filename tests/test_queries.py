"""Every registered query with SQL against DuckDB on the small tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from trackloom.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    cols = sorted(frame.columns)

    def plain(v):
        return None if pd.isna(v) else round(float(v), 5) if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind == "f" else str(v)

    return sorted((tuple(plain(v) for v in r) for r in frame[cols].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert len(got) or name in ("nothing",)
    if name in registry.ORACLE_SQL:
        want = duck.sql(registry.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
