"""Run registered queries against their check SQL.

    python tests/oracle_check.py [--sf sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canon(value):
    if value is None:
        return "~"
    if isinstance(value, float):
        return "~" if value != value else repr(value + 0.0)
    return str(value)


def compare(con, spark_df, sql: str) -> tuple[bool, str, int]:
    rows = spark_df.collect()
    names = spark_df.columns
    cur = con.execute(sql)
    other_names = [d[0] for d in cur.description]
    other = cur.fetchall()
    if sorted(names) != sorted(other_names):
        return False, f"columns {sorted(names)} vs {sorted(other_names)}", len(rows)
    order = sorted(names)
    mine = sorted(tuple(canon(r[n]) for n in order) for r in rows)
    idx = [other_names.index(n) for n in order]
    theirs = sorted(tuple(canon(r[i]) for i in idx) for r in other)
    if len(mine) != len(theirs):
        return False, f"rows {len(mine)} vs {len(theirs)}; first mine {mine[:1]} theirs {theirs[:1]}", len(rows)
    if mine != theirs:
        bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
        return False, f"{len(bad)} rows differ, columns {order}; e.g.\n   {bad[0][0]}\n   {bad[0][1]}", len(rows)
    kinds = {type(r[n]).__name__ for r in rows[:5] for n in order}
    return True, ",".join(sorted(kinds)), len(rows)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/{args.sf}"
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, plan in queries.items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        t = time.time()
        try:
            df = plan(spark, sf_dir)
            if name in oracle:
                ok, note, n = compare(con, df, oracle[name])
            else:
                n = len(df.collect())
                ok, note = True, "rows only"
        except Exception as exc:  # noqa: BLE001
            ok, note, n = False, f"{type(exc).__name__}: {str(exc)[:1500]}", -1
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:42s} rows={n:<7d} {time.time() - t:5.1f}s {'' if ok and name in oracle else note}", flush=True)
    print(f"{failed} failed")
    return int(failed > 0)


if __name__ == "__main__":
    raise SystemExit(main())
