"""Driver contract: entry() and every registered query on sf0.001, oracles via DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "total_points" in df.columns


def test_oracles_are_subset_and_named_alike():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _canon(rows):
    return sorted(tuple("NULL" if v is None else repr(float(v)) if isinstance(v, float) else str(v) for v in r)
                  for r in rows)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(df.columns) > 0
        return
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    si = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
    di = sorted(range(len(dcols)), key=lambda i: dcols[i])
    assert _canon([tuple(r[i] for i in si) for r in rows]) == _canon([tuple(r[i] for i in di) for r in res.fetchall()])
