"""Every query of the core agrees with its SQL, or at least runs, over the smallest tables."""

import pytest

from plainsift.plans import catalog
from tests.conftest import SMALL, same_as_sql


FIXED_COLUMNS = {"p3_cells": "/root/testdata/sf0.01"}  # the SQL states the columns that these tables fold to


@pytest.mark.parametrize("name", sorted(set(catalog.SQL) - set(FIXED_COLUMNS)))
def test_agrees_with_sql(spark, duck, name):
    same_as_sql(catalog.QUERIES[name](spark, SMALL), duck, catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(FIXED_COLUMNS))
def test_agrees_with_sql_at_its_scale(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view matrix_files as select * from '{FIXED_COLUMNS[name]}/matrix_files.parquet'")
    same_as_sql(catalog.QUERIES[name](spark, FIXED_COLUMNS[name]), con, catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() >= 0


def test_entry_is_the_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
