"""Compare registered queries with their SQL: ``python tests/run_checks.py sf_dir [name-part ...]``."""

import sys
import time
import traceback

sys.path[:0] = ["/root/repo", "/root/repo/tests"]

from harness import compare, connect  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from leadquarry.session import local_session  # noqa: E402

if __name__ == "__main__":
    sf, parts = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    oracles = entry.oracle_sql()
    bad = []
    for name, fn in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in oracles:
                ok, msg = compare(df, con, oracles[name])
            else:
                ok, msg = True, f"{len(df.collect())} rows, no sql"
        except Exception as e:
            ok, msg = False, "".join(traceback.format_exception_only(e))[:600]
        if not ok:
            bad.append(name)
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - t:.1f}s {msg[:900]}", flush=True)
    print("failed:", bad)
