"""Compare registered queries with their SQL: check.py [sf folder] [name ...]"""

from __future__ import annotations

import sys
import time

from tillbook.plans import registry
from tillbook.plans.compare import compare
from tillbook.session import build_session


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("check", "local[8]", {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    oracles, bad = registry.oracles(), 0
    for name, query in registry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            frame = query(spark, sf_dir)
            if name in oracles:
                problem = compare(frame, oracles[name], sf_dir)
            else:
                problem = None if frame.collect() else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        note = "ok" if problem is None else problem
        kind = "" if name in oracles else " (rows only)"
        print(f"{name}{kind} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main())
