"""Run a query and its SQL twin over the same tables and compare them row by row."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _text(v):
    if v is None or v != v:
        return "null"
    return repr(float(v)) if isinstance(v, float) else str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(_text, r)) for r in frame[columns].itertuples(index=False))


def differences(df, sql, sf_dir):
    a, b = rows(df.toPandas()), rows(connect(sf_dir).sql(sql).df())
    if a[0] != b[0] or len(a[1]) != len(b[1]):
        return [(a[0], len(a[1])), (b[0], len(b[1]))]
    return [(x, y) for x, y in zip(a[1], b[1], strict=True) if x != y][:5]
