"""Compare a query's rows with the rows of its SQL, whatever their order."""

from __future__ import annotations

import datetime
import decimal
import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, float):
        rounded = round(value, 9)
        return int(rounded) if rounded == int(rounded) else rounded
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _sorted(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(plain, key=repr)


def differences(df, con, sql: str) -> list[str]:
    """Empty if columns and rows agree."""
    ours = _sorted(df.columns, [tuple(row) for row in df.collect()])
    cursor = con.execute(sql)
    theirs = _sorted([c[0] for c in cursor.description], cursor.fetchall())
    if ours[0] != theirs[0]:
        return [f"columns {ours[0]} != {theirs[0]}"]
    if len(ours[1]) != len(theirs[1]):
        return [f"{len(ours[1])} rows != {len(theirs[1])} rows"]
    return [f"{a} != {b}" for a, b in zip(ours[1], theirs[1]) if a != b][:3]
