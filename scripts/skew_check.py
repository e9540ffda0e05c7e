"""Hot-key check: give one product a third of all line items, run the flagship
feature build, and print per-stage task record counts from Spark's event log.

Usage: python scripts/skew_check.py <empty scratch folder for the event log> [sf_dir]
"""

import sys, time, json, glob, io
from pathlib import Path
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import zstandard
from pyspark.sql import SparkSession, functions as F
from shelfcast.operators import features as fe
from shelfcast.operators.cleaning import price_cleaning
from shelfcast.sources import fixtures
d = sys.argv[1]
spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled","false")
         .config("spark.ui.showConsoleProgress","false")
         .config("spark.eventLog.enabled","true").config("spark.eventLog.dir", d)
         .config("spark.sql.shuffle.partitions","8").config("spark.sql.session.timeZone","UTC")
         .config("spark.driver.memory","16g").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
raw = fixtures.raw_transactions(spark, sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.1")
# One product takes a third of all line items.
hot = F.xxhash64("txn_id", "product_id") % 3 == 0
skewed = raw.withColumns({"product_id": F.when(hot, F.lit("HOT")).otherwise(F.col("product_id")),
                          "product_name": F.when(hot, F.lit("hot item")).otherwise(F.col("product_name")),
                          "category": F.when(hot, F.lit("HOT")).otherwise(F.col("category"))})
tx = price_cleaning(skewed)
t0 = time.perf_counter()
fe.build_features(tx, fe.WEEKLY, narrow=False).write.format("noop").mode("overwrite").save()
print("seconds", round(time.perf_counter() - t0, 2))
spark.stop()
stages = {}
for f in glob.glob(d + "/*/*"):
    rawb = open(f, "rb").read()
    if f.endswith(".zstd"):
        rawb = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(rawb)).read()
    for line in rawb.decode().splitlines():
        ev = json.loads(line)
        if ev["Event"] == "SparkListenerTaskEnd" and ev.get("Task Metrics"):
            m = ev["Task Metrics"]
            recs = m["Shuffle Read Metrics"]["Total Records Read"] + m["Input Metrics"]["Records Read"]
            stages.setdefault(ev["Stage ID"], []).append(recs)
for sid, recs in sorted(stages.items()):
    recs.sort()
    print("stage", sid, "tasks", len(recs), "max records", recs[-1], "median", recs[len(recs)//2], "total", sum(recs))
