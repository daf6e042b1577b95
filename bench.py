"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

The clean log is kept in memory once (`load` is that time), as the detectors of one workspace share it. With $BENCH_TIMES
above 1 the events are there so many times, each time with users of their own.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from accessloom import registry
from accessloom.operators import lookups
from accessloom.operators.detectors import Params
from accessloom.operators.evidence import flat_alerts
from accessloom.sources.log import clean, mapped


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    built = SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", str(cpus)).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    spark = built.config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def timed(name, make) -> None:
        began = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)

    began = time.perf_counter()
    events, times = spark.read.parquet(f"{sf}/events.parquet"), int(os.environ.get("BENCH_TIMES", "1"))
    if times > 1:
        users = events.agg(F.max("user_id") + 1).head()[0]
        events = events.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumns({"event_id": F.col("event_id") * times + F.col("_k"), "user_id": F.col("user_id") + F.col("_k") * users})
    log = clean(mapped(events)).cache()
    log.count()
    took["load"] = round(time.perf_counter() - began, 3)
    timed("q1_user_journey", lambda: lookups.user_journey(log, "U3"))
    timed("q2_resource_access", lambda: lookups.resource_access(log, "R26"))
    timed("q3_top_resources", lambda: lookups.top_resources(log))
    timed("q4_stats", lambda: lookups.stats(log))
    for kind, given in registry.SETTINGS.items():
        timed(f"{kind.lower()}_alerts", lambda kind=kind, given=given: flat_alerts(log, kind, Params.of(**given)))
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")), "times": times}))
    spark.stop()
    sys.stdout.flush()


if __name__ == "__main__":
    main()
