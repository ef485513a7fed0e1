"""The driver contract, and queries against DuckDB at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from gramloom import queries as core

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["split_sandwich", "formula_full_rank", "cat_rmatvec_high_card", "from_df_catalog"])
def test_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = core.QUERIES[name](spark, DIR).toPandas()
    want = con.sql(core.SQL[name]).df()[list(got.columns)]
    rows = lambda d: sorted(map(tuple, d.astype(object).values.tolist()))
    assert rows(got) == rows(want)
