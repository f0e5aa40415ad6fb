"""Compares a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

KINDS = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "FLOAT": "float"}


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    return x


def bag(rows) -> Counter:
    return Counter(tuple(map(_plain, r)) for r in rows)


def differences(spark, sf_dir: str, run, sql: str) -> list[str]:
    """What differs: names, types, rows.  No difference gives an empty list."""
    df = run(spark, sf_dir)
    got = connection(sf_dir).execute(sql)
    theirs = {d[0]: str(d[1]) for d in got.description}
    ours = dict(df.dtypes)
    if set(theirs) != set(ours):
        return [f"columns {sorted(ours)} and {sorted(theirs)}"]
    names = sorted(ours)
    out = [f"{c}: {ours[c]} and {theirs[c]}" for c in names if KINDS.get(theirs[c], theirs[c]) != ours[c]]
    order = [list(theirs).index(c) for c in names]
    a, b = bag(map(tuple, df.select(*names).collect())), bag(tuple(r[k] for k in order) for r in got.fetchall())
    if a != b:
        out.append(f"{sum(a.values())} and {sum(b.values())} rows; only ours {list((a - b).items())[:2]}; only theirs {list((b - a).items())[:2]}")
    return out
