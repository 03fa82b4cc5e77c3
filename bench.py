"""Time every registered query and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3 warm runs, of
which the median counts; a query that takes longer than BENCH_BUDGET, default 2 seconds, in total runs no more). Each
query runs to the last row of its result, which is then thrown away.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from casebook.queries import fact, ledger_house, queries, staged, warehouse
from casebook.session import session


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    budget = float(os.environ.get("BENCH_BUDGET", "2"))
    only = sys.argv[1:]
    spark = session("tallyhouse-bench")

    start = time.perf_counter()
    consume(staged(spark, sf_dir).limit(1))
    fact(spark, sf_dir)
    setup = time.perf_counter() - start

    # Three loads of lines and two of marts; the queries named w_ only read what they leave.
    start = time.perf_counter()
    if not only or any(part in "w_" or "w_" in part for part in only):
        warehouse(spark, sf_dir)
    loads = time.perf_counter() - start

    # Three loads of many ledgers, read by the queries named w_owners_.
    start = time.perf_counter()
    if not only or any(part in "w_owners_" or "w_owners_" in part for part in only):
        ledger_house(spark, sf_dir)
    owner_loads = time.perf_counter() - start

    seconds: dict[str, float] = {}
    for name, build in queries().items():
        if only and not any(part in name for part in only):
            continue
        consume(build(spark, sf_dir))
        timed = []
        for _ in range(runs):
            start = time.perf_counter()
            consume(build(spark, sf_dir))
            timed.append(time.perf_counter() - start)
            if sum(timed) > budget:
                break
        seconds[name] = round(statistics.median(timed), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "sum of median query seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "setup_sec": round(setup, 3),
                "loads_sec": round(loads, 3),
                "owner_loads_sec": round(owner_loads, 3),
            }
        )
    )


if __name__ == "__main__":
    main()
