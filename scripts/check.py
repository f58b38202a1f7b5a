"""Run registered queries against DuckDB: python scripts/check.py [sf_dir] [name ...]"""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from brineframe.plans.registry import all_queries
from brineframe.session import local_session
from tests.oracle import compare, connect

args = sys.argv[1:]
sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
spark = local_session(os.environ.get("CPUS", "8"))
con = connect(sf_dir)
bad = 0
for name, q in all_queries().items():
    if args and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) for a in args):
        continue
    t = time.time()
    try:
        if q.sql:
            problem, n = compare(spark, con, q, sf_dir)
        else:
            problem, n = None, len(q.run(spark, sf_dir).collect())
    except Exception as err:
        text = str(err) if os.environ.get("FULL") else str(err)[:600]
        problem, n = f"{type(err).__name__}: {text}", -1
        if os.environ.get("FULL"):
            traceback.print_exc()
    bad += problem is not None
    print(f"{'FAIL' if problem else 'ok'} {name} rows={n} {time.time() - t:.1f}s {'' if q.sql else '(rows only)'} {problem or ''}", flush=True)
print("failed:", bad)
