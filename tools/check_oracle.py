"""Run every registered query and its oracle text; print a line per key.

usage: python tools/check_oracle.py [sf_dir] [key ...]
"""

import sys
import time

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from strata.plans import oracle_sql, queries  # noqa: E402
from strata.plans.compare import compare, duckdb_connection  # noqa: E402
from strata.session import local_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
keys = sys.argv[2:]
spark = local_session(8)
con = duckdb_connection(sf)
qs, ors = queries(), oracle_sql()
ok_n = fail_n = 0
for k in keys or sorted(qs):
    t = time.time()
    try:
        sdf = qs[k](spark, sf).toPandas()
    except Exception as e:  # noqa: BLE001
        print(f"FAIL {k}: spark error {type(e).__name__}: {str(e)[:300]}")
        fail_n += 1
        continue
    st = time.time() - t
    if k not in ors:
        print(f"ROWS {k}: {len(sdf)} rows, {st:.1f}s (no oracle)")
        continue
    try:
        odf = con.sql(ors[k]).df()
    except Exception as e:  # noqa: BLE001
        print(f"FAIL {k}: duckdb error {str(e)[:300]}")
        fail_n += 1
        continue
    ok, msg = compare(sdf, odf)
    ok_n += ok
    fail_n += not ok
    print(f"{'OK  ' if ok else 'FAIL'} {k}: {msg} ({st:.1f}s)")
print(f"ok={ok_n} fail={fail_n}")
