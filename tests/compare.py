"""A query's rows against those of DuckDB."""

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return bytes(v) if isinstance(v, bytearray) else v


def connection(data):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        at = f"{data}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    return c


def same(spark, data, query, sql):
    df = query(spark, data)
    names = sorted(df.columns)
    got = sorted((tuple(_plain(r[n]) for n in names) for r in df.collect()), key=repr)
    cursor = connection(data).execute(sql)
    at = [d[0] for d in cursor.description]
    assert sorted(at) == names
    want = sorted((tuple(_plain(r[at.index(n)]) for n in names) for r in cursor.fetchall()), key=repr)
    assert got == want
