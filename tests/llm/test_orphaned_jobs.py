"""A query that ends early, as one side of a join is found empty, leaves no job behind that would wait for shuffle files that are gone."""

import time

from pyspark.sql import functions as F
from trackloom.llm import common


def test_no_job_is_left(spark):
    def slowly(batches):
        for b in batches:
            time.sleep(8)
            yield b

    none = spark.range(100).select((F.col("id") % 7).alias("id")).where("id > 8").groupBy("id").count()
    slow = spark.range(0, 4, 1, 1).mapInArrow(slowly, "id long").distinct()
    active = spark.sparkContext.statusTracker().getActiveJobsIds
    for run in (common.gathered, common.checkpointed, common.written):
        began = time.time()
        out = run(none.join(F.broadcast(slow), "id"))
        assert time.time() - began < 7, "the query waited for the slow side, so this test shows nothing"
        for _ in range(30):
            if not active():
                break
            time.sleep(0.1)
        assert not active()
        assert not (out if isinstance(out, list) else out.collect())
    assert not spark.sparkContext.getJobTags()
