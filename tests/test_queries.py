"""Every registered query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_file

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def core_names():
    from orebody.plans import catalogue

    return sorted(catalogue.ORACLES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", core_names())
def test_query_matches_sql(spark, duck, name):
    df = entry_file.queries()[name](spark, SF)
    names = sorted(df.columns)
    found = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    result = duck.execute(entry_file.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names
    places = [columns.index(c) for c in names]
    assert found == sorted(tuple(plain(r[i]) for i in places) for r in result.fetchall())


def test_entry_has_rows(spark):
    assert entry_file.entry(spark).count() > 0
