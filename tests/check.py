"""Run queries against their SQL: ``python tests/check.py SF_DIR [name part ...]``."""

import sys
import time

sys.path[:0] = [".", "tests"]

from compare import connection, difference  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from lakescribe.session import local_session  # noqa: E402

if __name__ == "__main__":
    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connection(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            result = difference(df, con, oracles[name]) if name in oracles else f"rows {df.count()} (no sql)"
        except Exception as error:  # report and go on
            result = f"ERROR {str(error)[:1500]}"
        ok = result is None or "(no sql)" in result
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {time.time() - start:6.1f}s {name} {result or ''}", flush=True)
    print("bad:", bad)
