"""Compare a Spark query with the DuckDB SQL that must give the same rows."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v + 0.0, 5) + 0.0
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v.asDict().values())
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return v


def compare(df, con, sql):
    """Empty if the rows agree (or there is no SQL and the query runs), else what differs."""
    if sql is None:
        return "" if df.count() >= 0 else "no rows"
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = sorted(names)
    want = sorted(((plain([r[names.index(c)] for c in order])) for r in rel.fetchall()), key=repr)
    got = sorted((plain([r[c] for c in order]) for r in df.collect()), key=repr)
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}: {got[:2]} {want[:2]}"
    diff = [(a, b) for a, b in zip(got, want) if a != b]
    if diff:
        return f"{len(diff)} of {len(got)} rows differ, as {order} {diff[0]}"
    return "" if got else "no rows on either side"
