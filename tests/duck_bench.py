"""Times DuckDB on the SQL of the headline queries, beside bench.py: ``python tests/duck_bench.py``."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from bench import HEADLINE  # noqa: E402
from cellweave.plans.catalogue import ORACLE_SQL  # noqa: E402


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    con = duckdb.connect()
    con.execute(f"SET threads = {os.environ.get('BENCH_CPUS', '8')}")
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):  # the first one warms up
            began = time.perf_counter()
            con.execute(ORACLE_SQL[name]).fetchall()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs[1:]), 4)
    print(json.dumps({"engine": "duckdb", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": os.path.basename(folder)}))


if __name__ == "__main__":
    main()
