"""Compare a query's rows with its SQL in DuckDB on the same files."""

import glob
import os

import duckdb


def connect(at):
    con = duckdb.connect()
    for p in glob.glob(f"{at}/*.parquet"):
        name = os.path.basename(p).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def _value(v):
    return round(v, 7) if isinstance(v, float) else v


def differences(spark, at, name, queries, oracles):
    df = queries[name](spark, at)
    got = df.collect()
    rel = connect(at).sql(oracles[name])
    want = rel.fetchall()
    cols, wcols = sorted(df.columns), sorted(rel.columns)
    if cols != wcols:
        return f"columns {cols} / {wcols}"
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a = sorted((tuple(_value(r[c]) for c in cols) for r in got), key=key)
    at_ = [rel.columns.index(c) for c in cols]
    b = sorted((tuple(_value(r[i]) for i in at_) for r in want), key=key)
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(bad)} rows differ: {bad[0]}" if bad else None
