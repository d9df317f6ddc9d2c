"""``python tests/run_oracle.py [sf_dir] [query ...]``: compares queries with their oracles, with timings."""

import sys
import time
import traceback
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parents[1])]

import __spark_entry__ as driver  # noqa: E402
from compare import connect, differences  # noqa: E402

from plumbline import build_session  # noqa: E402

sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
wanted = sys.argv[2:]
spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g", spark__ui__showConsoleProgress="false")
oracle, db = driver.oracle_sql(), connect(sf_dir)
bad = 0
for name, query in driver.queries().items():
    if wanted and not any(w in name for w in wanted):
        continue
    start = time.time()
    try:
        table = query(spark, sf_dir).toArrow()
        took = time.time() - start
        if name not in oracle:
            print(f"{name:30} {took:6.1f}s rows only: {table.num_rows}", flush=True)
            continue
        start = time.time()
        expected = db.sql(oracle[name]).to_arrow_table()
        found = differences(table, expected)
        bad += bool(found)
        print(f"{name:30} {took:6.1f}s oracle {time.time() - start:5.1f}s {table.num_rows} rows", "OK" if not found else "\n   ".join(["DIFFERENT", *found]), flush=True)
    except Exception as error:  # report and go on with the next query
        bad += 1
        print(f"{name:30} FAILED {type(error).__name__} {str(error)[:700]}", flush=True)
        if wanted:
            traceback.print_exc()
print("bad:", bad)
