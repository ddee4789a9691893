"""Times the registered queries of the detection engine at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    from pyspark.sql import SparkSession

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from trackloom.plans import registry

    # starting the JVM and the Python workers isn't any query's time
    began = time.time()
    spark.range(1000).mapInPandas(lambda frames: frames, "id long").groupBy("id").count().write.format("noop").mode("overwrite").save()
    registry.QUERIES["suppress_counts"](spark, sf).write.format("noop").mode("overwrite").save()
    warm = round(time.time() - began, 3)
    seconds = {}
    for name, f in registry.QUERIES.items():
        began = time.time()
        f(spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf, "warm_up": warm}))


main()
