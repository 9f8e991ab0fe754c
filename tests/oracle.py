"""Runs a registered query and its SQL oracle side by side."""

import glob
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{files}')")
    return con


def _plain(x):
    if isinstance(x, float):
        return repr(x + 0.0)
    return str(x) if x is not None else None


def compare(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    ours = sorted(tuple(str(_plain(r[c])) for c in names) for r in df.collect())
    con = connect(sf_dir)
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == names, (sorted(cols), names)
    order = [cols.index(c) for c in names]
    theirs = sorted(tuple(str(_plain(r[i])) for i in order) for r in rel.fetchall())
    assert len(ours) == len(theirs), (len(ours), len(theirs))
    wrong = [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b]
    assert not wrong, (len(wrong), wrong[0])
    return len(ours)
