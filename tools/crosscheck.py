"""Compare registered queries with their SQL counterparts: crosscheck.py <sf dir> [name part ...]."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from casebook import compare, oracle
from casebook.queries import queries
from casebook.session import session

if __name__ == "__main__":
    sf, parts = sys.argv[1], sys.argv[2:]
    spark, connection = session(), compare.connect(sf)
    sql, failed = oracle.oracle_sql(), []
    for name, build in queries().items():
        if parts and not any(part in name for part in parts):
            continue
        start = time.time()
        try:
            found = compare.differences(build(spark, sf), connection, sql[name]) if name in sql else ["no SQL"]
        except Exception as error:
            found = [str(error)[:1500]]
        print(f"{name:34s} {time.time() - start:6.2f}s", "ok" if not found else f"DIFFERS {found}", flush=True)
        failed += [name] if found else []
    print(f"{len(failed)} differ: {failed}")
