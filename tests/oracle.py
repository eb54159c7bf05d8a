"""Comparison of a Spark result with the rows of its SQL."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def assert_same(df, con, sql):
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted((tuple(r[columns.index(c)] for c in order) for r in found.fetchall()), key=repr)
    got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)
    assert got == want
