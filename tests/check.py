"""Run registered queries against their SQL twins: ``check.py [sf] [name…]``."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from syllabica.session import build_session  # noqa: E402
from tests.compare import connect, differences  # noqa: E402


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    spark = build_session(cores=8)
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                problem = differences(df, oracles[name], con)
                status = "ok" if problem is None else f"DIFF {problem}"
            else:
                status = f"rows {len(df.collect())}"
        except Exception as error:  # noqa: BLE001
            status = f"ERROR {str(error)[:900]}"
        if not status.startswith(("ok", "rows")):
            bad += 1
        print(f"{name:34s} {time.time() - start:6.2f}s {status}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
