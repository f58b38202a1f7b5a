"""Side-by-side comparison of a registered query and its DuckDB form."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = []
    for row in rows:
        cells = []
        for i in order:
            v = row[i]
            if isinstance(v, float):
                v = "nan" if math.isnan(v) else repr(v)
            cells.append(str(v))
        out.append(tuple(cells))
    return sorted(out)


def compare(spark, con, q, sf_dir, df=None):
    """(problem or None, number of rows)"""
    df = q.run(spark, sf_dir) if df is None else df
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(q.sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(got)
    a, b = canonical(got, df.columns), canonical(want, names)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}", len(got)
    for x, y in zip(a, b):
        if x != y:
            diff = sum(p != r for p, r in zip(a, b))
            return f"{diff} of {len(a)} rows differ, first {x} != {y} (columns {sorted(names)})", len(got)
    return None, len(got)
