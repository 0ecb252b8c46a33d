"""Every registered query of the risk operators runs, and those with SQL agree with it."""

import pandas as pd
import pytest

from riskloom.plans import registry

duckdb = pytest.importorskip("duckdb")
TABLES = ["customer", "supplier", "orders", "events", "documents", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return c


def _rows(frame, columns):
    def plain(v):
        return None if pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted((tuple(plain(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees_with_sql(spark, sf_dir, con, name):
    got, want = registry.queries()[name](spark, sf_dir).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert _rows(got, columns) == _rows(want, columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
