"""Compares a query with its DuckDB SQL on the tables of a directory."""

import os

import duckdb


def rows_of(df):
    columns = sorted(df.columns)
    return sorted(map(str, (tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())))


def oracle_rows(sql, sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(map(str, (tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in cur.fetchall())))


def assert_matches(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    names, want = oracle_rows(sql, sf_dir)
    assert sorted(df.columns) == names
    assert rows_of(df) == want
