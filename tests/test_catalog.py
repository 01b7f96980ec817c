"""Every query with an oracle gives the oracle's rows."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from cliplane.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def rows(df):
    def clean(v):
        if v is None or v is pd.NA or v != v:
            return None
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    cols = sorted(df.columns)
    return cols, sorted(([clean(v) for v in r] for r in df[cols].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, DATA).toPandas()) == rows(duck.sql(catalog.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_others_run(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0
