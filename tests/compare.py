"""Run registered queries next to their DuckDB SQL and compare rows.

    python tests/compare.py [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0) if not value.is_integer() or math.isinf(value) else repr(float(value) + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_plain(v) for v in value) + "]"
    return f"{type(value).__name__[:3]}:{value}"


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(_plain(r[n]) for n in names) for r in df.select(*[f"`{n}`" for n in names]).collect())


def duck_rows(con, sql: str):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in cursor.fetchall())


def difference(left, right, limit: int = 3) -> str:
    (ln, lr), (rn, rr) = left, right
    if ln != rn:
        return f"columns {ln} != {rn}"
    if lr == rr:
        return ""
    ls, rs = set(lr), set(rr)
    only_left = [r for r in lr if r not in rs][:limit]
    only_right = [r for r in rr if r not in ls][:limit]
    return f"{len(lr)} vs {len(rr)} rows\n   spark {str(only_left)[:900]}\n   duck  {str(only_right)[:900]}"


def main() -> int:
    from timbre.session import build_session
    from timbre.plans import ORACLES, QUERIES

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if wanted and not any(name == w or name.startswith(f"{w}_") or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        started = time.time()
        try:
            rows = spark_rows(fn(spark, sf_dir))
            spent = time.time() - started
            if name not in ORACLES:
                print(f"ROWS {name} {len(rows[1])} {spent:.2f}s", flush=True)
                continue
            started = time.time()
            expected = duck_rows(con, ORACLES[name])
            text = difference(rows, expected)
            if not rows[1]:
                text = text or "no rows"
            print(f"{'ok  ' if not text else 'FAIL'} {name} {len(rows[1])} {spent:.2f}s duck {time.time() - started:.2f}s {text}", flush=True)
            bad += bool(text)
        except Exception as exc:
            bad += 1
            print(f"ERR  {name} {type(exc).__name__} {str(exc)[:1500]}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
