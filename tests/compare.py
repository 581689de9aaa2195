"""Runs named queries on Spark and their reference SQL on DuckDB and compares all values.

Usage: python tests/compare.py [name-or-prefix ...]   (BENCH_SF_DIR picks the tables)
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

SF = os.environ.get("COMPARE_SF_DIR", "/root/testdata/sf0.01")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v) if not isinstance(v, bool) else ("true" if v else "false")


def oracle_rows(con, sql):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    types = [str(d[1]) for d in cur.description]
    return cols, types, cur.fetchall()


def sorted_rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def connect():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def main(names):
    import __spark_entry__ as entry
    from evidentia.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect()
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for name, fn in queries.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        t0 = time.time()
        try:
            df = fn(spark, SF)
            rows = [tuple(r) for r in df.collect()]
            t1 = time.time()
            if name not in oracles:
                print(f"rows {name}: {len(rows)} rows, {t1 - t0:.1f}s")
                continue
            cols, types, want = oracle_rows(con, oracles[name])
            t2 = time.time()
            sc, srows = sorted_rows(df.columns, rows)
            oc, orows = sorted_rows(cols, want)
            ok = sc == oc and srows == orows
            tag = "ok  " if ok else "DIFF"
            print(f"{tag} {name}: {len(rows)} rows, spark {t1 - t0:.1f}s duckdb {t2 - t1:.1f}s", flush=True)
            if not ok:
                bad.append(name)
                print("   columns", sc, oc, len(srows), len(orows))
                s, o = set(srows), set(orows)
                print("   only spark ", [str(x)[:400] for x in list(s - o)[:2]])
                print("   only oracle", [str(x)[:400] for x in list(o - s)[:2]])
        except Exception as exc:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL {name}: {str(exc)[:700]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
