"""Every query of the core and of the jobs against its SQL in DuckDB."""

import math

import duckdb
import pytest

from jobs import queries as jobs
from terrafold import queries_files as files
from terrafold.queries import ORACLE_SQL, QUERIES

DATA, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


def views(folder):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def tables():
    return views(DATA)


@pytest.fixture(scope="module")
def small_tables():
    return views(SMALL)


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return format(float(v) + 0.0, ".7g")
    return str(v).removesuffix(" 00:00:00")


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, tables, name):
    got = QUERIES[name](spark, DATA)
    found = tables.execute(ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, found.fetchall())


@pytest.mark.parametrize("name", [*sorted(files.ORACLE_SQL), *sorted(jobs.ORACLE_SQL)])
def test_files_and_jobs_equal_sql(spark, small_tables, name):
    """Those that write and read back, on the small tables."""
    got = (files.QUERIES | jobs.QUERIES)[name](spark, SMALL)
    found = small_tables.execute((files.ORACLE_SQL | jobs.ORACLE_SQL)[name])
    names = [c[0] for c in found.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, found.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL) and set(files.QUERIES) == set(files.ORACLE_SQL) and set(jobs.QUERIES) == set(jobs.ORACLE_SQL)
