"""Runs registered queries on Spark beside their SQL on DuckDB and compares values and types."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float) and v == 0:
        return 0.0
    if isinstance(v, list):
        return tuple(_cell(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def compare(spark, con, name, plan, sql, sf):
    t0 = time.time()
    df = plan(spark, sf)
    plan_text = df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
    if "CartesianProduct" in plan_text or "BroadcastNestedLoopJoin" in plan_text:
        return "PLAN pairs every row of two tables", time.time() - t0, 0.0
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return f"rows={len(got[1])}", t1 - t0, 0.0
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    t2 = time.time()
    if got[0] != want[0]:
        return f"COLUMNS {got[0]} != {want[0]}", t1 - t0, t2 - t1
    if len(got[1]) != len(want[1]):
        return f"ROWS {len(got[1])} != {len(want[1])}\n   {got[1][:2]}\n   {want[1][:2]}", t1 - t0, t2 - t1
    for a, b in zip(got[1], want[1]):
        if repr(a) != repr(b):
            return f"VALUES\n   spark {a}\n   duck  {b}", t1 - t0, t2 - t1
    return "ok", t1 - t0, t2 - t1


def main():
    from plumbline.plans.catalogue import PLANS, SQL
    from plumbline.session import local_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    names = sys.argv[1:] or list(PLANS)
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    bad = 0
    for n in names:
        try:
            msg, a, b = compare(spark, con, n, PLANS[n], SQL.get(n), sf)
        except Exception as e:  # noqa: BLE001
            msg, a, b = f"ERROR {type(e).__name__} {str(e)[:600]}", 0, 0
        ok = msg == "ok" or msg.startswith("rows=")
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {n:40s} {a:6.2f}s {b:6.2f}s {'' if msg == 'ok' else msg}", flush=True)
    print("failed", bad, "of", len(names))


if __name__ == "__main__":
    main()
