"""Every query with SQL against DuckDB on sf0.001."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from thalweg.plans import scenes, workflows  # noqa: F401
from thalweg.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("nation", "supplier", "part", "lineitem", "events", "documents", "embeddings"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(frame):
    cell = lambda v: "null" if pd.isna(v) else str(v)[:10] if hasattr(v, "year") else v if isinstance(v, str) else f"{float(v):.5f}"
    return sorted(tuple(cell(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE_SQL:
        assert plain(got) == plain(duck.execute(ORACLE_SQL[name]).df())
    else:
        assert len(got)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
