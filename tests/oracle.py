"""Run registered queries against their SQL: ``python tests/oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, (int, float)):
        return (2, "nan" if isinstance(value, float) and math.isnan(value) else repr(round(float(value), 6) + 0.0))
    return (3, str(value))


def table(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(normal(r[i]) for i in order) for r in rows)


def compare(spark, con, name, run, sql, sf_dir):
    started = time.time()
    df = run(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - started
    if sql is None:
        return "rows-only", len(got), took, ""
    cursor = con.execute(sql)
    want = cursor.fetchall()
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    left, right = table(got, df.columns), table(want, [d[0] for d in cursor.description])
    spark_kinds = dict(df.dtypes)
    odd = {
        c: (spark_kinds[c], kinds[c])
        for c in spark_kinds
        if c in kinds and (spark_kinds[c], kinds[c]) not in SAME_TYPES
    }
    if left[0] != right[0]:
        return "COLUMNS", len(got), took, f"{set(left[0]) ^ set(right[0])}"
    if len(left[1]) != len(right[1]):
        return "ROWS", len(got), took, f"{len(left[1])} vs {len(right[1])}"
    off = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
    if off:
        names = [left[0][i] for i, (x, y) in enumerate(zip(*off[0])) if x != y]
        return "VALUES", len(got), took, f"{len(off)} rows; {names}\n   {off[0][0]}\n   {off[0][1]}"
    return "ok", len(got), took, f"types {odd}" if odd else ""


SAME_TYPES = {
    ("bigint", "BIGINT"),
    ("int", "INTEGER"),
    ("double", "DOUBLE"),
    ("string", "VARCHAR"),
    ("boolean", "BOOLEAN"),
}


def main() -> int:
    import __spark_entry__ as entry
    from pulsegate.session import build_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = build_session(
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    con, sqls, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if args and not any(a in name for a in args):
            continue
        try:
            status, rows, took, note = compare(spark, con, name, run, sqls.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001
            status, rows, took, note = "ERROR", 0, 0.0, str(exc)[:900]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += status not in ("ok", "rows-only")
        print(f"{status:10s} {name:34s} rows={rows:<7d} {took:6.2f}s {note}", flush=True)
    print("failed:", bad)
    return int(bad > 0)


if __name__ == "__main__":
    raise SystemExit(main())
