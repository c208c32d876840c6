"""Every core query against its SQL, on the smallest driver tables; and on empty tables for being defined."""

import os

import duckdb
import pandas as pd
import pytest

from pagesmith.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are missing")


def rows(df):
    df = df[sorted(df.columns)]
    text = lambda v: "NULL" if v is None or v is pd.NA or v is pd.NaT or v != v else f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(text, r)) for r in df.astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    ours = registry.queries()[name](spark, DATA).toPandas()
    theirs = duck.execute(registry.oracle_sql()[name]).fetch_df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for f in os.listdir(DATA):
        spark.read.parquet(f"{DATA}/{f}").limit(0).write.parquet(str(d / f))
    return str(d)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - {"synthetic_docs", "latex_cases"}))
def test_empty_tables(spark, empty, name):
    assert registry.queries()[name](spark, empty).count() == 0


def test_entry_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "furniture_classes" in e.queries()
