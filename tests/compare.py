"""Comparing a query's rows with those of its SQL."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _value(v):
    return None if isinstance(v, float) and math.isnan(v) else v


def _shown(v) -> str:
    """For the order of rows: floats by what does not depend on the order of summing."""
    return f"{v:.4g}" if isinstance(v, float) else str(v)


def _same(a, b) -> bool:
    numbers = all(isinstance(x, int | float | Decimal) and not isinstance(x, bool) for x in (a, b))
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) if numbers else a == b


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k].lower())
    out = [tuple(_value(r[k]) for k in order) for r in rows]
    return sorted(out, key=lambda r: (tuple((x is None, _shown(x)) for x in r if not isinstance(x, float)), tuple((x is None, _shown(x)) for x in r)))


def difference(df, con, sql: str) -> str | None:
    """None where rows and column names agree, else what differs first."""
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    want = rows_of(names, result.fetchall())
    got = rows_of(df.columns, df.collect())
    if sorted(n.lower() for n in names) != sorted(c.lower() for c in df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(want) != len(got):
        return f"{len(got)} rows and {len(want)}"
    for a, b in zip(got, want, strict=True):
        if not all(map(_same, a, b)):
            return f"{str(a)[:300]} and {str(b)[:300]}"
    return None
