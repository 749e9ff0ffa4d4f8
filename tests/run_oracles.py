"""Run registered queries against their DuckDB twins: ``python tests/run_oracles.py [names]``."""

from __future__ import annotations

import os
import sys
import time
import traceback

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
sys.path.insert(0, HERE)

import oracle_queries  # noqa: E402
from oracle_compare import compare, duck  # noqa: E402
from ticketscope.plans.catalog import QUERIES  # noqa: E402
from ticketscope.session import build_session  # noqa: E402


def main(argv):
    sf = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
    names = argv or sorted(QUERIES)
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck(sf)
    sqls = oracle_queries.oracles()
    bad = 0
    for n in names:
        t = time.time()
        try:
            df = QUERIES[n](spark, sf)
            if n in sqls:
                ok, msg = compare(df, con, sqls[n])
            else:
                ok, msg = True, f"rows-only: {df.count()} rows"
        except Exception:
            ok, msg = False, traceback.format_exc(limit=3)[-1500:]
        bad += not ok
        print(f"{'OK ' if ok else 'BAD'} {n:28s} {time.time() - t:6.2f}s {msg}", flush=True)
    print(f"{len(names) - bad}/{len(names)} passed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
