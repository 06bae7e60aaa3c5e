"""Compare named queries with their SQL: python tests/check.py SF_DIR [name ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _key(row):
    return tuple((v is not None, str(type(v)), v) if not isinstance(v, float) else (True, "float", v) for v in row)


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted((tuple(r[n] for n in names) for r in df.collect()), key=lambda r: [str(v) for v in r])


def rows_of_sql(con, sql):
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    names = sorted(columns)
    order = [columns.index(n) for n in names]
    return names, sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=lambda r: [str(v) for v in r])


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return a == b


def differences(spark, con, q, sf_dir, limit=3):
    names, got = rows_of_spark(q.run(spark, sf_dir))
    expected_names, want = rows_of_sql(con, q.sql)
    if names != expected_names:
        return [f"columns {names} != {expected_names}"]
    if len(got) != len(want):
        return [f"{len(got)} rows, expected {len(want)}"]
    found = [
        {n: (x, y) for n, x, y in zip(names, g, w) if not same(x, y)} | {"row": g[:2]}
        for g, w in zip(got, want)
        if not all(map(same, g, w))
    ]
    return [f"{len(found)} of {len(got)} rows differ", *map(str, found[:limit])] if found else []


if __name__ == "__main__":
    from tillwatch.plans.all_queries import CATALOG
    from tillwatch.session import local_session

    sf, chosen = sys.argv[1], sys.argv[2:]
    spark, con = local_session(8), duck(sf)
    bad = 0
    for name, q in CATALOG.items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            if q.sql is None:
                n = len(q.run(spark, sf).collect())
                result = [] if n else ["no rows"]
            else:
                result = differences(spark, con, q, sf)
        except Exception as e:  # report and go on with the next query
            result = [f"{type(e).__name__}: {str(e)[:600]}"]
        bad += bool(result)
        print(f"{'FAIL' if result else 'ok  '} {name} {time.time() - start:.2f}s", flush=True)
        for line in result:
            print("     ", line[:700], flush=True)
    print(f"{bad} failed")
