"""Holds a query's rows against DuckDB's for the same tables."""

import os

import duckdb


def rows(frame):
    cols = sorted(frame.columns)
    return sorted(tuple("" if v is None or v != v else str(v) for v in r) for r in frame[cols].astype(object).itertuples(index=False))


def same(spark, sf, query, sql):
    got = query(spark, sf).toPandas()
    con = duckdb.connect()
    for p in os.listdir(sf):
        con.execute(f"CREATE VIEW {p.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{p}'")
    want = con.execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
