"""Run named queries (all by default) against SQL: python tests/check.py [-s sf] [-f family] [names]."""

from __future__ import annotations

import argparse
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import compare, connect  # noqa: E402

from cellgraph.plans import catalog  # noqa: E402
from cellgraph.session import build_session  # noqa: E402

if __name__ == "__main__":
    ap = argparse.ArgumentParser()
    ap.add_argument("-s", default="0.01")
    ap.add_argument("-f", nargs="*", default=None)
    ap.add_argument("--no-sql", action="store_true")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    if args.f:
        catalog.FAMILIES = tuple(args.f)
    qs = catalog.load_all()
    folder = f"/root/testdata/sf{args.s}"
    spark = build_session("local[8]", "check", shuffle_partitions=8, driver_memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in args.names or list(qs):
        q = qs[name]
        t0 = time.time()
        try:
            df = catalog.spark_callable(q)(spark, folder)
            if q.sql and not args.no_sql:
                msg = compare(df, con, q.sql)
                note = "ok" if msg is None else f"DIFF {msg[:700]}"
            else:
                note = f"rows {len(df.collect())}"
                msg = None
        except Exception as e:  # report and go on
            msg = note = "FAIL " + "".join(traceback.format_exception_only(e))[:900]
        bad += msg is not None
        print(f"{name:34s} {time.time()-t0:6.2f}s {note}", flush=True)
    print(f"{bad} of {len(args.names or qs)} bad")
