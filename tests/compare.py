"""A Spark result against SQL on the same tables."""

from __future__ import annotations

import datetime
from pathlib import Path

import duckdb


def cell(v):
    if v is None:
        return (0,)
    if isinstance(v, bool):
        return (1, float(v))
    if isinstance(v, datetime.date):
        return (3, str(v)[:10])
    try:
        return (1, round(float(v), 9) + 0.0)
    except (TypeError, ValueError):
        return (4, str(v))


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in found)


def same(df, sql: str, folder: str) -> None:
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    d = con.execute(sql)
    names = [c[0] for c in d.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, d.fetchall())
