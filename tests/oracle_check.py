"""Run a registered query in Spark and its oracle in DuckDB and compare all values."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return 0.0 if v == 0 else v
    return v


def compare(spark_rows, spark_cols, duck_rows, duck_cols) -> str | None:
    """None when equal, else what differs. Values and their types must agree exactly."""
    if sorted(spark_cols) != sorted(duck_cols):
        return f"columns {sorted(set(spark_cols) ^ set(duck_cols))}"
    order = sorted(spark_cols)
    si = [list(spark_cols).index(c) for c in order]
    di = [list(duck_cols).index(c) for c in order]
    a = Counter(tuple(_norm(r[i]) for i in si) for r in spark_rows)
    b = Counter(tuple(_norm(r[i]) for i in di) for r in duck_rows)
    for left, right in zip(next(iter(a), ()), next(iter(b), ())):
        if left is not None and right is not None and type(left) is not type(right):
            return f"types {type(left)} {type(right)} in {order}"
    if a == b:
        return None
    only_a, only_b = a - b, b - a
    return (f"rows {sum(a.values())} vs {sum(b.values())}, differing {sum(only_a.values())}: "
            f"{order} spark {sorted(map(repr, only_a))[:2]} duck {sorted(map(repr, only_b))[:2]}")


def check(spark, con, name, query, oracle, sf_dir) -> str | None:
    df = query(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(oracle)
    cols = [d[0] for d in cur.description]
    return compare(rows, df.columns, cur.fetchall(), cols)
