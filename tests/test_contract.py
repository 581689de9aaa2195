"""Every named query equals its reference SQL on the smallest tables."""

import compare
import pytest

import __spark_entry__ as entry

compare.SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.connect()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "query_id"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, sf, name):
    df = entry.queries()[name](spark, sf)
    cols, _types, want = compare.oracle_rows(con, ORACLES[name])
    got = compare.sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    assert got == compare.sorted_rows(cols, want)
