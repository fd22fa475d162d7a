"""Runs a query and its SQL side by side and compares rows as multisets."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    found = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        found.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return found


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def differences(spark, sf_dir: str, name: str, queries: dict, sql: dict) -> str:
    """Empty if the query's rows are those of its SQL."""
    df = queries[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    con = connect(sf_dir)
    found = con.execute(sql[name])
    names = [d[0] for d in found.description]
    if sorted(names) != columns:
        return f"columns {columns} and {sorted(names)}"
    order = [names.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)
    if ours == theirs:
        return ""
    first = next(((a, b) for a, b in zip(ours, theirs, strict=False) if a != b), None)
    return f"{len(ours)} and {len(theirs)} rows; first difference {first}"
