import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SQL = entry.oracle_sql()
SF = "/root/testdata/sf0.001"


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = plain(tuple(r) for r in df.select(*columns).collect())
    cur = con.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})")
    expected = plain(cur.fetchall())
    assert [repr(a) for a in got] == [repr(b) for b in expected]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
