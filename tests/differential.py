"""Runs a query in Spark and its SQL in DuckDB over the same tables and compares the rows."""

import os

import duckdb

FOLDER = "/root/testdata/sf0.001"


def database(folder=FOLDER):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in os.listdir(folder):
        path = os.path.join(folder, name)
        con.execute(f"create view {name.split('.')[0]} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    flat = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(flat(r[i]) for i in order) for r in rows), key=str), [columns[i] for i in order]


def compare(spark, query, sql, con, folder=FOLDER):
    df = query(spark, folder)
    relation = con.sql(sql)
    assert rows_of(df.columns, df.collect()) == rows_of(relation.columns, relation.fetchall())
