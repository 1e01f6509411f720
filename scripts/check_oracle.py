"""Compare every registered query (or those named on the command line) with its
DuckDB oracle: ``python scripts/check_oracle.py [--sf DIR] [names...]``."""

import argparse
import json
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from rolloutlab.plans.catalog import ORACLES, QUERIES  # noqa: E402
from rolloutlab.plans.compare import compare, duck  # noqa: E402
from rolloutlab.session import get_spark  # noqa: E402


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = get_spark("local[8]", 8)
    con = duck(args.sf)
    bad = 0
    for name in args.names or sorted(QUERIES):
        try:
            res = compare(spark, con, name, QUERIES[name], ORACLES.get(name), args.sf)
        except Exception as e:  # report and continue with the next query
            res = {"query": name, "status": f"ERROR {type(e).__name__}: {str(e)[:400]}"}
        bad += res["status"] not in ("match", "rows-only")
        print(json.dumps(res), flush=True)
    print(json.dumps({"failed": bad, "total": len(args.names or QUERIES)}))
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
