"""Every registered query of the engine with SQL gives the same rows as DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from docmill import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def shown(df):
    cols = sorted(df.columns)
    return df[cols].astype(str).replace({"None": "nan", "<NA>": "nan", "NaT": "nan"}).sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_same_rows(spark, duck, name):
    ours = plans.queries()[name](spark, SF).toPandas()
    theirs = duck.sql(plans.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert shown(ours).equals(shown(theirs))


def test_others_run(spark):
    for name in set(plans.queries()) - set(plans.oracle_sql()):
        assert plans.queries()[name](spark, SF).count() > 0
