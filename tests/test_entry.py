"""Every registered query against its SQL on the smoke tables."""

import glob
import numbers
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from sparkloom.plans import catalogue

NAMES = sorted(catalogue.queries())


def normal(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = []
    for row in frame.itertuples(index=False):
        rows.append(tuple(None if pd.isna(x) else round(float(x), 6) if isinstance(x, numbers.Number) and not isinstance(x, bool) else str(x) for x in row))
    return sorted(rows, key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, smoke_dir, name):
    got = entry.queries()[name](spark, smoke_dir).toPandas()
    sql = entry.oracle_sql().get(name)
    assert len(got.columns)
    if sql is None:
        return
    db = duckdb.connect()
    for path in glob.glob(f"{smoke_dir}/*.parquet"):
        db.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    expected = db.execute(sql).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert normal(got) == normal(expected)
