"""Compares a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(x):
    """One form for values that both engines call equal."""
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, dict):
        return tuple(sorted((k, _plain(v)) for k, v in x.items()))
    if hasattr(x, "asDict"):
        return _plain(x.asDict())
    if isinstance(x, list | tuple):
        return tuple(map(_plain, x))
    return x


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(df, sql: str, sf_dir: str) -> str:
    """What differs, or an empty string."""
    with duckdb.connect() as db:
        db.execute("SET TimeZone = 'UTC'")
        for t in TABLES:
            if Path(f"{sf_dir}/{t}.parquet").exists():
                path = f"{sf_dir}/{t}.parquet"
                db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if Path(path).is_dir() else path}')")
        got = db.execute(sql)
        names = [x[0] for x in got.description]
        want = rows_of(names, got.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)}, expected {sorted(names)}"
    found = rows_of(df.columns, df.collect())
    if found == want:
        return ""
    return f"{sum(found.values())} rows, expected {sum(want.values())}; only found {list((found - want).items())[:2]}; only expected {list((want - found).items())[:2]}"
