"""Registered queries against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from tessera.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(df):
    df = df[sorted(df.columns)]
    rows = []
    for r in df.itertuples(index=False):
        row = []
        for v in r:
            if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
                row.append(None)
            elif isinstance(v, float):
                row.append(int(v) if float(v).is_integer() else round(float(v), 9))
            else:
                row.append(v.item() if hasattr(v, "item") else str(v) if not isinstance(v, (str, int, bool)) else v)
        rows.append(tuple(row))
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)


def test_entry_without_the_optional_parts(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
