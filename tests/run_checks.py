"""python tests/run_checks.py [sf] [name prefix ...]: run queries against their SQL."""

import sys
import time

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
sys.path.insert(0, __file__.rsplit("/", 1)[0])

from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as driver  # noqa: E402
from oracle import compare, connect  # noqa: E402

sf, names = (sys.argv[1:2] or ["0.01"])[0], sys.argv[2:]
spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
folder = f"/root/testdata/sf{sf}"
con = connect(folder)
queries, oracles, failed = driver.queries(), driver.oracle_sql(), 0
for key, fn in queries.items():
    if names and not any(key.startswith(n) for n in names):
        continue
    start = time.time()
    try:
        if key in oracles:
            note = compare(spark, folder, fn, oracles[key], con)
        else:
            rows = fn(spark, folder).count()
            note = "" if rows >= 0 else "no rows"
    except Exception as err:  # noqa: BLE001
        note = f"{type(err).__name__}: {str(err)[:600]}"
    failed += bool(note)
    kind = "sql " if key in oracles else "rows"
    print(f"{'FAIL' if note else 'ok  '} {kind} {time.time() - start:6.2f}s {key} {note}", flush=True)
print(f"{failed} failed")
