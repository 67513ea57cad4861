"""Every registered query that SQL can express, against DuckDB on the same tables."""

import duckdb
import pandas as pd
import pytest

from quorate.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def normal(df):
    df = df[sorted(df.columns)].astype(object)
    clean = lambda v: None if pd.isna(v) else round(float(v), 9) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(map(clean, row)) for row in df.values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows(spark, sf, duck, name):
    got, want = registry.QUERIES[name](spark, sf).toPandas(), duck.execute(registry.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(want) > 0
    assert normal(got) == normal(want)


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert len(rows) == 8 and set(e.oracle_sql()) <= set(e.queries())
