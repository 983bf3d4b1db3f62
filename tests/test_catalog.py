"""Every registered query against its DuckDB twin, on whole tables."""

import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from helixframe import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for t in TABLES:
        found.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return found


def plain(value):
    return float(value) if isinstance(value, decimal.Decimal) else value


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    if name not in catalog.oracle_sql():
        return
    want = con.sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())
    assert got or name in EMPTY


#: Queries that may be empty on the smallest tables.
EMPTY = {"unique_regions", "core_regions", "transcripts", "filtered_counts", "modes", "uncovered_features", "kmer_threshold", "varying_features"}


def test_entry_point(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["sample", "fid", "n", "rpm"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
