"""Compare a query with its SQL on the same files: rows, columns, types by family and values."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        files = sorted(glob.glob(f"{path}/*.parquet")) if os.path.isdir(path) else [path]
        con.execute(f"create view {t} as select * from read_parquet({files!r})")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if hasattr(x, "asDict"):
        return tuple(plain(v) for v in x)
    if hasattr(x, "normalize") and hasattr(x, "as_tuple"):
        return float(x)
    return x


def difference(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty if they agree."""
    df = query(spark, sf_dir)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    kinds = {c[0]: str(c[1]) for c in cur.description}
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    key = lambda r: repr(r)
    want = sorted((tuple(plain(dict(zip(names, r))[c]) for c in order) for r in cur.fetchall()), key=key)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.select(*order).collect()), key=key)
    family = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    types = [(c, t, kinds[c]) for c, t in df.dtypes if t in family and kinds[c] not in (family[t],)]
    if got != want:
        pairs = [(a, b) for a, b in zip(got, want) if a != b][:2]
        return f"{len(got)} and {len(want)} rows; {pairs}"
    return f"types {types}" if types else ""
