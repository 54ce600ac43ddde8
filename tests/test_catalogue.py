"""Queries against their SQL twins, on the smallest data set."""

import os

import duckdb
import pytest

from tidewright.plans.catalogue import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def _cell(v):
    return round(float(v), 6) if isinstance(v, float) else v if v is None else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cursor = con.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(set(columns)) == sorted(columns)
    wanted = sorted(str([_cell(r[columns.index(c)]) for c in sorted(columns)]) for r in cursor.fetchall())
    got = sorted(str([_cell(r[c]) for c in sorted(columns)]) for r in df.collect())
    assert got == wanted


def test_every_query_has_a_twin():
    assert set(ORACLE) == set(QUERIES)
