"""Command-line check: python tests/check_queries.py SF_DIR [name part ...]."""

import sys
import time

sys.path.insert(0, ".")
from compare import difference, duck  # noqa: E402

from fleetmeter import session  # noqa: E402
from fleetmeter.plans import catalog  # noqa: E402

if __name__ == "__main__":
    sf, wanted = sys.argv[1], sys.argv[2:]
    spark = session.build(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    queries, oracles = catalog.queries(), catalog.oracle_sql()
    failed = 0
    for name, job in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            df = job(spark, sf)
            if name in oracles:
                problem = difference(df, con, oracles[name])
            else:
                problem = None if df.count() >= 0 else "?"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += problem is not None
        note = "" if name in oracles else " (rows only)"
        print(f"{'ok ' if problem is None else 'BAD'} {name}{note} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print("failed:", failed)
