"""Developer tool: compare registered queries against their DuckDB oracle.

    python tests/check_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from spanlab.plans.compare import compare, duck  # noqa: E402
from spanlab.plans.registry import REGISTRY  # noqa: E402
from spanlab.session import local_session  # noqa: E402


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or list(REGISTRY)
    spark = local_session(8)
    con = duck(sf_dir)
    bad = 0
    for name in names:
        fn, sql = REGISTRY[name]
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            if sql is None:
                n = df.count()
                res = {"rows_only": n}
            else:
                res = compare(df, con, sql)
                bad += 0 if res["match"] else 1
        except Exception as e:  # report and continue
            res = {"error": repr(e)[:800]}
            bad += 1
        res["sec"] = round(time.time() - t0, 2)
        print(name, json.dumps(res, default=str), flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
