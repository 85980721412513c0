"""Run a registered query in Spark and its SQL twin in DuckDB, and compare the row multisets."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return int(v) if v == int(v) and abs(v) < 1e15 else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def compare(df, con, sql: str):
    """(ok, message) of Spark rows against the rows of the SQL."""
    cols = sorted(df.columns)
    left = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    if sorted(names) != cols:
        return False, f"columns differ: spark {cols} sql {sorted(names)}"
    order = [names.index(c) for c in cols]
    right = Counter(tuple(norm(r[i]) for i in order) for r in res.fetchall())
    n = sum(left.values())
    if left == right:
        return True, f"{n} rows"
    only_l, only_r = left - right, right - left
    return False, (f"{n} vs {sum(right.values())} rows; {sum(only_l.values())} only in spark, "
                   f"{sum(only_r.values())} only in sql\n   cols {cols}\n   spark {str(list(only_l)[:2])[:900]}"
                   f"\n   sql   {str(list(only_r)[:2])[:900]}")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
