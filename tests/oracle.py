"""Runs registered queries and their SQL twins side by side: ``python -m tests.oracle [folder] [name part ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(x):
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if hasattr(x, "as_tuple"):
        return float(x)
    return x


def rows_of_spark(df) -> tuple[list, list]:
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def rows_of_sql(con, sql: str) -> tuple[list, list]:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)


def difference(df, con, sql: str) -> str:
    (a, x), (b, y) = rows_of_spark(df), rows_of_sql(con, sql)
    if a != b:
        return f"columns {a} and {b}"
    if len(x) != len(y):
        return f"{len(x)} and {len(y)} rows, as {[r for r in x if r not in set(y)][:2]} and {[r for r in y if r not in set(x)][:2]}"
    bad = [(r, s) for r, s in zip(x, y, strict=True) if r != s]
    return f"{len(bad)} of {len(x)} rows differ, as {bad[0]}" if bad else ""


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    con, sql = connection(folder), e.oracle_sql()
    for name, f in e.queries().items():
        if len(sys.argv) > 2 and not any(part in name for part in sys.argv[2:]):
            continue
        if name.startswith("op") or name == "pipeline":
            if len(sys.argv) <= 2:
                continue
        t = time.time()
        try:
            df = f(session, folder)
            said = difference(df, con, sql[name]) if name in sql else f"no SQL, {df.count()} rows"
        except Exception as x:
            said = f"{type(x).__name__}: {str(x)[:700]}"
        print(f"{name}: {said or 'same'} ({time.time() - t:.1f} s)", flush=True)
