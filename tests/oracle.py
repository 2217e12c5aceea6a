"""Runs a query in Spark and its SQL in DuckDB over the same files."""

import glob
import os


def shown(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    return repr(v) if isinstance(v, float) else str(v)


def connection(folder):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f if os.path.isfile(f) else f + '/*.parquet'}'")
    return con


def same(spark, con, query, sql, folder):
    df = query(spark, folder)
    columns = sorted(df.columns)
    mine = sorted((tuple(shown(r[c]) for c in columns) for r in df.collect()), key=str)
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = sorted((tuple(shown(r[i]) for i in at) for r in cursor.fetchall()), key=str)
    assert len(mine) == len(theirs)
    assert mine == theirs
