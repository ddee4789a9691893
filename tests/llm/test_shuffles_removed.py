"""What the near-duplicate stage gathers on the driver leaves no shuffle files on the executors' disks."""

import time

from pyspark.sql import functions as F
from trackloom.llm import common, simhash, substring


def files(spark) -> set:
    """Shuffle files of the one executor."""
    there = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in (there.apply(i).getName() for i in range(there.size())) if f.startswith("shuffle_") and f.endswith(".data")}


def left(spark, before: set) -> set:
    # files are deleted a moment after their query ends
    for _ in range(30):
        if not (more := files(spark) - before):
            break
        time.sleep(0.1)
    return more


def test_gathered_and_bitmap(spark):
    rows = spark.range(5_000).select((F.col("id") % 700).alias("s"))
    counted = rows.groupBy("s").count()
    before = files(spark)
    assert sum(r["count"] for r in common.gathered(counted)) == 5_000
    assert not left(spark, before)
    bits = substring.bitmap(counted.select("s"), "s", 1 << 15)
    assert sum(bin(b).count("1") for b in bits) == 700
    assert not left(spark, before)


def test_near_duplicates_before_its_rows_are_read(spark, monkeypatch):
    seen = []

    def noted(make):
        def run(*args):
            out = make(*args)
            if len(seen) < 2:  # the bitmap of shared shingles, then the first table: all that reads whole texts before pairs are made
                seen.append(left(spark, before))
            return out

        return run

    for name in ("bitmap", "written"):
        monkeypatch.setattr(simhash, name, noted(getattr(simhash, name)))
    texts = [" ".join(f"w{(k * 7 + i) % 90}" for i in range(30 + k % 5)) for k in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = files(spark)
    simhash.drop_near_duplicates(df)
    assert seen == [set(), set()]
