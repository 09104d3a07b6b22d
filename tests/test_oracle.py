"""Every registered query with oracle SQL gives DuckDB's rows."""

import duckdb
import pandas as pd
import pytest

from wardstone.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(df):
    text = lambda v: "null" if v is None or v is pd.NaT or isinstance(v, float) and v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    df = df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None)
    return sorted(tuple(text(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else text(v) for v in row) for row in df.itertuples(index=False))


@pytest.mark.parametrize("key", sorted(registry.SQL))
def test_query_equals_oracle(spark, sf, duck, key):
    got, want = registry.QUERIES[key](spark, sf).toPandas(), duck.sql(registry.SQL[key]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
