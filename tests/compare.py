"""Query results of Spark and DuckDB as sorted rows with columns by name."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(norm(v) for v in r) for r in df.select(names).toPandas().astype(object).where(lambda p: p.notna(), None).values.tolist()), key=str)


def duck_rows(sql, sf):
    con = duckdb.connect()
    import os

    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    rel = con.sql(sql)
    names = sorted(rel.columns)
    order = [rel.columns.index(n) for n in names]
    return names, dict(zip(rel.columns, map(str, rel.types))), sorted((tuple(norm(r[i]) for i in order) for r in rel.fetchall()), key=str)
