"""Run queries and their SQL on the same tables and compare the results.

    python -m checks.compare [--sf DIR] [name prefix ...]
"""

import argparse
import glob
import os
import sys
import time
import traceback

import duckdb

from docrecords.session import local_session

from . import catalog


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple("<null>" if r[i] is None else str(r[i]) for i in order) for r in rows)
    )


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--show", type=int, default=3)
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = local_session("checks", "8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for path in glob.glob(f"{args.sf}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    bad = []
    for name, fn in catalog.QUERIES.items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        try:
            t0 = time.time()
            df = fn(spark, args.sf)
            got = df.collect()
            t1 = time.time()
            if name not in catalog.ORACLE:
                print(f"rows {name:34s} {len(got):8d} rows  spark {t1 - t0:5.1f}s", flush=True)
                continue
            cur = con.execute(catalog.ORACLE[name])
            names = [d[0] for d in cur.description]
            want = cur.fetchall()
            t2 = time.time()
            a, b = normal(got, df.columns), normal(want, names)
            same = sorted(names) == sorted(df.columns) and a == b
            print(
                f"{'ok  ' if same else 'DIFF'} {name:34s} {len(got):8d} rows  spark {t1 - t0:5.1f}s  sql {t2 - t1:5.1f}s",
                flush=True,
            )
            if not same:
                bad.append(name)
                print("   columns", sorted(df.columns), sorted(names), len(a), len(b))
                sa, sb = set(a), set(b)
                for x in sorted(sa - sb)[: args.show]:
                    print("   spark:", x)
                for x in sorted(sb - sa)[: args.show]:
                    print("   sql:  ", x)
        except Exception as error:  # report every query, then fail
            bad.append(name)
            print(f"FAIL {name}: {str(error)[:1500]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
