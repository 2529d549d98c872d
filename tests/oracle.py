"""Runs a query and its SQL on one folder and compares the rows."""

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings proteins split_members hits clan_map "
    "test_items target_mix split_plan size_limits"
).split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def rows_of(df):
    names = sorted(df.columns)
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr), names


def same(spark, con, folder, query, sql):
    got, names = rows_of(query(spark, folder))
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == names
    order = [cols.index(c) for c in names]
    want = sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=repr)
    assert got == want
