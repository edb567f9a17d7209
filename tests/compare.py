"""Run queries in Spark and their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, folder, name, query, sql) -> str | None:
    """None if equal, else a short description of the difference."""
    df = query(spark, folder)
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = duck(folder).execute(sql)
    right = rows_of([d[0] for d in found.description], found.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} vs {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"{len(left[1])} rows vs {len(right[1])}"
    for a, b in zip(left[1], right[1]):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{a}\n      vs {b}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from tabloom.queries import registry
    from tabloom.session import local_session

    spark = local_session("8")
    folder = sys.argv[1]
    queries, oracles = registry()
    bad = 0
    for name, query in queries.items():
        if len(sys.argv) > 2 and not any(a in name for a in sys.argv[2:]):
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = compare(spark, folder, name, query, oracles[name])
            else:
                problem = None if query(spark, folder).count() else "no rows"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s {'' if name in oracles else '(no SQL)'}",
              problem or "", flush=True)
    print("bad:", bad)
