"""The by-size and whole-table queries leave no detection out."""

import os

from trackloom.plans import registry
from trackloom.sources.detections import detections

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_every_row_is_on_one_side(spark):
    every = registry._side(spark, SF).count()
    assert every == detections(spark, SF).count()
    assert registry._side(spark, SF, 320).count() + registry._side(spark, SF, 640).count() == every


def test_no_query_takes_part_of_its_table():
    text = " ".join(registry.ORACLE_SQL.values())
    assert "pos % " not in text and "event_id % " not in text
