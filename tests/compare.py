"""Runs a query and its SQL over the same tables and compares the rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def by_sql(sql, folder=None, **frames):
    con = duckdb.connect()
    for t in TABLES.split() if folder else ():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    for name, frame in frames.items():
        con.register(name, frame)
    found = con.sql(sql)
    return found.columns, found.fetchall()


def ordered(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


def same(df, sql, folder=None, **frames):
    assert ordered(df.columns, [tuple(r) for r in df.collect()]) == ordered(*by_sql(sql, folder, **frames))
