"""Compare a Spark result with what DuckDB gives for its SQL, row for row."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool) or isinstance(v, str):
        return v
    if isinstance(v, int | float):
        return round(float(v), 9)
    return str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def assert_same(spark_df, relation):
    assert sorted(spark_df.columns) == sorted(relation.columns)
    assert rows(spark_df.columns, spark_df.collect()) == rows(relation.columns, relation.fetchall())
