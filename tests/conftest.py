"""One session for all tests, and the comparison with DuckDB."""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from plainsift.shared import ship

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(value):
    """A value in a form in which both engines' results are equal."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime | datetime.date):
        return value.isoformat()
    return value


def rows_of(df) -> list:
    cols = sorted(df.columns)
    return sorted((tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)


def same_as_sql(df, duck, sql: str) -> None:
    found = duck.sql(sql)
    cols = sorted(found.columns)
    assert sorted(df.columns) == cols
    want = sorted((tuple(plain(v) for v in r) for r in found.select(", ".join(f'"{c}"' for c in cols)).fetchall()), key=repr)
    assert rows_of(df) == want
