"""Run a query and its SQL over one data folder and compare rows, as the driver does."""

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        files = sorted(glob.glob(f"{p}/*.parquet")) if os.path.isdir(p) else [p]
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet({files})")
    return con


def norm(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return repr(v)


def compare(df, sql, sf_dir):
    """None when equal, else what differs."""
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    rel = duck(sf_dir).execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != cols:
        return f"columns {cols} against {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())
    if got == want:
        return None
    miss = [x for x in want if x not in set(got)][:2]
    more = [x for x in got if x not in set(want)][:2]
    return f"{len(got)} rows against {len(want)}; only SQL {miss}; only Spark {more}"
