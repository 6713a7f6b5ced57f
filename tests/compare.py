"""Runs a query in Spark and its SQL in DuckDB and compares the rows as multisets."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connected(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 9) + 0.0
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(repr(tuple(plain(x) for x in r)) for r in df.select(*[f"`{n}`" for n in names]).collect())


def sql_rows(con, sql):
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    order = [names.index(n) for n in sorted(names)]
    return sorted(names), sorted(repr(tuple(plain(r[i]) for i in order)) for r in cur.fetchall())
