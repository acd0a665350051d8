"""All registered queries run, and agree with their SQL on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")


def normal(v):
    return round(v, 6) if isinstance(v, float) else v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_every_query_agrees_with_its_sql(spark, data_root):
    import __spark_entry__ as entry

    con = duckdb.connect()
    for f in os.listdir(data_root):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{data_root}/{f}'")
    wrong = []
    for name, sql in entry.oracle_sql().items():
        df = entry.queries()[name](spark, data_root)
        cols = sorted(df.columns)
        got = ordered(tuple(normal(r[c]) for c in cols) for r in df.collect())
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols, name
        want = ordered(tuple(normal(r[names.index(c)]) for c in cols) for r in cur.fetchall())
        if got != want:
            wrong.append(name)
    assert wrong == []


def test_entry(spark, data_root):
    import __spark_entry__ as entry

    if data_root != "/root/testdata/sf0.001":
        pytest.skip("entry() reads the smallest tables")
    assert entry.entry(spark).count() > 0
