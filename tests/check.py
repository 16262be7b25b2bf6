"""Command line: python tests/check.py SF [name-prefix ...] -- compare queries with their SQL."""

from __future__ import annotations

import os
import sys
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import compare, connect  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from varloom.session import local_session  # noqa: E402

if __name__ == "__main__":
    sf, wanted = sys.argv[1], sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracles = entry.oracle_sql()
    bad = n = 0
    for name, run in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        n += 1
        try:
            r = compare(spark, folder, name, run, oracles.get(name), con)
        except Exception as e:  # report and go on
            r = {"query": name, "status": "ERROR", "detail": str(e)[:500]}
            if os.environ.get("TRACE"):
                traceback.print_exc()
        if r["status"] not in ("match", "rows_only"):
            bad += 1
        if r["status"] not in ("match", "rows_only") or os.environ.get("ALL"):
            print(r, flush=True)
        elif r["sec"] > 8 or r.get("sql_sec", 0) > 8:
            print("slow", r["query"], r["sec"], r.get("sql_sec"), flush=True)
    print(f"{n} queries, {bad} bad")
