"""Spark rows against DuckDB rows: sorted columns, order-insensitive, floats to nine digits."""

import datetime
import decimal
import math
import os

import duckdb


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat() + "T00:00:00"
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


def duck(folder):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in os.listdir(folder):
        p = os.path.join(folder, t)
        c.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def same(df, connection, sql):
    cols = sorted(df.columns)
    got = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
    rel = connection.execute(sql)
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = [tuple(norm(r[i]) for i in at) for r in rel.fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
