"""Holds registered queries against their DuckDB SQL."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    return str(value)


def sql_rows(sql, sf_dir, columns):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    found = con.sql(sql)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    return sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def assert_equal(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sql_rows(sql, sf_dir, columns)
