"""Run a query and its SQL over the same tables and compare rows."""

import glob
import math
import os

import duckdb


def tables(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def plain(rows):
    fix = lambda v: round(v, 6) + 0.0 if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(fix(v) for v in r) for r in rows), key=repr)


def compare(spark, query, sql, sf_dir):
    got = query(spark, sf_dir)
    names = sorted(got.columns)
    rel = tables(sf_dir).sql(sql)
    assert sorted(rel.columns) == names
    order = [rel.columns.index(n) for n in names]
    want = [tuple(r[i] for i in order) for r in rel.fetchall()]
    assert plain(tuple(r) for r in got.select(*names).collect()) == plain(want)
