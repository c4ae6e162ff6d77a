"""Runs a query and its SQL side by side."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9) + 0.0
    return x


def rows_of_sql(sql, sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    found = db.sql(sql)
    order = sorted(range(len(found.columns)), key=lambda k: found.columns[k])
    return [found.columns[k] for k in order], sorted((tuple(_value(r[k]) for k in order) for r in found.fetchall()), key=str)


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted((tuple(_value(r[c]) for c in names) for r in df.collect()), key=str)


def assert_same(df, sql, sf_dir):
    spark_names, spark_rows = rows_of_spark(df)
    sql_names, sql_rows = rows_of_sql(sql, sf_dir)
    assert spark_names == sql_names
    assert len(spark_rows) == len(sql_rows)
    for a, b in zip(spark_rows, sql_rows, strict=True):
        assert a == b
