"""Spark queries against their DuckDB SQL on the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def values(frame, columns):
    plain = frame[columns].astype(object)
    return sorted(map(str, plain.where(frame[columns].notna(), None).values.tolist()))


def same(spark, query, sql, sf_dir):
    """The query's rows, after a check that they equal the SQL's."""
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got, want = query(spark, sf_dir).toPandas(), con.sql(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert values(got, columns) == values(want, columns)
    return got
