"""Runs registered queries in Spark and their checks in DuckDB and compares the rows."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

from gradeloom.catalog.views import TABLES


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(float(v) + 0.0)
    if isinstance(v, int):
        return str(v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, fn, sql):
    """(number of rows, list of problems)"""
    df = fn(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "NestedLoop" in plan or "Cartesian" in plan:
        return 0, ["the plan pairs every row with every row"]
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return len(got), []
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    problems = []
    if sorted(names) != sorted(df.columns):
        return len(got), [f"columns {sorted(df.columns)} vs {sorted(names)}"]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    for c, t in df.dtypes:
        k = kinds[c]
        if ("DECIMAL" in k) or ("HUGEINT" in k) or (t == "double") != ("DOUBLE" in k or k == "NUMBER" and t == "double"):
            problems.append(f"type of {c}: {t} vs {k}")
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        extra, missing = a - b, b - a
        problems.append(f"{len(got)} vs {len(want)} rows; {sum(extra.values())} only in Spark, {sum(missing.values())} only in DuckDB")
        problems += [f"  spark  {str(x)[:600]}" for x in sorted(extra)[:3]]
        problems += [f"  duckdb {str(x)[:600]}" for x in sorted(missing)[:3]]
    return len(got), problems


def main(argv):
    from gradeloom.session import build_session
    from __spark_entry__ import oracle_sql, queries

    sf = argv[0] if argv else "0.01"
    only = set(argv[1:])
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = duck(sf_dir)
    qs, oracle = queries(), oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t = time.time()
        try:
            n, problems = compare(spark, con, sf_dir, fn, oracle.get(name))
        except Exception as e:  # report and go on with the next query
            n, problems = -1, [f"{type(e).__name__}: {str(e)[:900]}"]
        mark = "ok " if not problems else "BAD"
        if not problems and n == 0:
            mark = "EMPTY"
        bad += bool(problems)
        print(f"{mark} {name:28s} rows={n:7d} {time.time() - t:6.2f}s {'' if name in oracle else '(rows only)'}", flush=True)
        for p in problems:
            print("     ", p, flush=True)
    print(f"{len(qs)} queries, {len(oracle)} checked, {bad} bad")


if __name__ == "__main__":
    main(sys.argv[1:])
