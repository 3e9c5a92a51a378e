"""Compares a query's rows with those of its oracle in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

DATA = Path("/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        files = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{files}')")
    return con


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, bool | int) or x is None:
        return str(x)
    if isinstance(x, bytes | bytearray):
        return bytes(x).hex()
    return repr(list(x)) if isinstance(x, list) else str(x)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(df, sql: str, sf_dir: str) -> str:
    """Empty if all is equal."""
    con = connect(sf_dir)
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    kinds = {c[0]: str(c[1]) for c in want.description}
    if sorted(names) != sorted(df.columns):
        return f"columns: {sorted(df.columns)}, oracle {sorted(names)}"
    a, b = rows_of(df.columns, df.collect()), rows_of(names, want.fetchall())
    same = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
    wrong = [f"{c}: {k} / {kinds[c]}" for c, k in df.dtypes if k in same and same[k] != kinds[c]]
    if a != b:
        only_a, only_b = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
        return f"{len(a)} rows, oracle {len(b)}; only here {only_a}, only there {only_b}"
    return f"types differ: {wrong}" if wrong else ""
