"""Comparing runs: coverage joins, A/B differences, coverage change, common keys and nearest pairing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.boxes import iou
from .intervals import range_join

BUCKET = 0.5


def uncovered(det: DataFrame, boxes: DataFrame, bucket: float = BUCKET) -> DataFrame:
    """Detections whose centre lies in no box of their label that is live at t, ends and edges included (J8). boxes: bx, by, bw, bh."""
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    inside = (cx >= F.col("bx")) & (cx <= F.col("bx") + F.col("bw")) & (cy >= F.col("by")) & (cy <= F.col("by") + F.col("bh"))
    return range_join(det, boxes, ["entity_id", "class_id"], "t", "start", "stop", bucket, "left_anti", inside)


def overlaps(a: DataFrame, b: DataFrame, min_iou: float = 0.3, bucket: float = BUCKET) -> DataFrame:
    """Pairs (a_id, b_id), some more than once, of the same entity and label that overlap in time (ends included) and by IoU (J9). Rows need id, start, stop and a box."""
    cut = lambda d, p: d.select("entity_id", "class_id", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("stop") / bucket))).alias("k"), *[F.col(c).alias(f"{p}{c}") for c in ("id", "start", "stop", "x", "y", "w", "h")])
    return cut(a, "a_").join(cut(b, "b_"), ["entity_id", "class_id", "k"]).where((F.col("a_start") <= F.col("b_stop")) & (F.col("b_start") <= F.col("a_stop")) & (iou("a_", "b_") >= min_iou)).select("a_id", "b_id")


def covered_flags(a: DataFrame, b: DataFrame, min_iou: float = 0.3, bucket: float = BUCKET) -> DataFrame:
    """a with covered: whether some row of b overlaps it."""
    hits = overlaps(a, b, min_iou, bucket).select(F.col("a_id").alias("id")).distinct().withColumn("_c", F.lit(True))
    return a.join(hits, "id", "left").withColumn("covered", F.coalesce("_c", F.lit(False))).drop("_c")


def ab_diff(current: DataFrame, proposed: DataFrame, min_iou: float = 0.3) -> DataFrame:
    """Per entity: rows of both, of the current run only, of the proposed run only (J10). The overlaps are found once, for both sides."""
    hits = overlaps(current, proposed, min_iou).select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a_id").alias("id")), F.struct(F.lit(1).alias("side"), F.col("b_id").alias("id")))).alias("s")).select("s.*").distinct().withColumn("_c", F.lit(True))
    rows = current.select("entity_id", "id", F.lit(0).alias("side")).unionByName(proposed.select("entity_id", "id", F.lit(1).alias("side")))
    n = lambda side, found: F.count_if((F.col("side") == side) & (F.col("_c").isNotNull() if found else F.col("_c").isNull()))
    return rows.join(hits, ["side", "id"], "left").groupBy("entity_id").agg(n(0, True).alias("in_both"), n(0, False).alias("current_only"), n(1, False).alias("proposed_only"))


def coverage_change(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(after - before) / before per key, where before is positive."""
    b, a = before.select(*keys, F.col(value).alias("before")), after.select(*keys, F.col(value).alias("after"))
    return b.join(a, keys, "left").where("before > 0").withColumn("change", (F.coalesce("after", F.lit(0.0)) - F.col("before")) / F.col("before"))


def in_every(df: DataFrame, value: str, configuration: str) -> DataFrame:
    """Values that every configuration has."""
    n = df.select(F.countDistinct(configuration).alias("_all"))
    return df.groupBy(value).agg(F.countDistinct(configuration).alias("_n")).join(F.broadcast(n), F.col("_n") == F.col("_all")).select(value)  # n: one row


def paired(current: DataFrame, other: DataFrame, score_tolerance: float, place_tolerance: float) -> DataFrame:
    """Boxes of two runs matched instant by instant, each to the nearest (by corner) remaining one of its label, in order of pos.

    Rows entity_id, t, class_id, a_pos, b_pos (null where a box has none), score_diff, place_diff and outcome: exact, tolerant or mismatch. Instants meet by t
    rounded to six places. The greedy choice is a fold over one instant's boxes of a label.
    """
    cols = ["pos", *"xywh", "score"]
    group = ["entity_id", "t", "class_id"]
    side = lambda d, n: d.select("entity_id", F.bround("t", 6).alias("t"), "class_id", F.struct(F.col("pos").cast("int").alias("pos"), *[F.col(c).cast("double").alias(c) for c in cols[1:]]).alias("b")).groupBy(*group).agg(F.sort_array(F.collect_list("b")).alias(n))
    none = "cast(array() as array<struct<pos:int,x:double,y:double,w:double,h:double,score:double>>)"
    both = side(current, "a").join(side(other, "b"), group, "full").withColumns({"a": F.expr(f"coalesce(a, {none})"), "b": F.expr(f"coalesce(b, {none})")})
    far = "named_struct('d', (o.x - p.x) * (o.x - p.x) + (o.y - p.y) * (o.y - p.y), 'i', i)"
    pick = f"array_min(transform(acc.left, (o, i) -> {far})).i + 1"
    step = f"if(size(acc.left) = 0, named_struct('left', acc.left, 'out', concat(acc.out, array(named_struct('p', p, 'q', cast(null as struct<pos:int,x:double,y:double,w:double,h:double,score:double>))))), named_struct('left', filter(acc.left, (o, i) -> i <> {pick} - 1), 'out', concat(acc.out, array(named_struct('p', p, 'q', acc.left[{pick} - 1])))))"
    start = "named_struct('left', b, 'out', cast(array() as array<struct<p:struct<pos:int,x:double,y:double,w:double,h:double,score:double>,q:struct<pos:int,x:double,y:double,w:double,h:double,score:double>>>))"
    m = both.withColumn("m", F.expr(f"aggregate(a, {start}, (acc, p) -> {step})"))
    extra = "transform(m.left, o -> named_struct('p', cast(null as struct<pos:int,x:double,y:double,w:double,h:double,score:double>), 'q', o))"
    rows = m.select(*group, F.explode(F.expr(f"concat(m.out, {extra})")).alias("r"))
    score = F.abs(F.col("r.p.score") - F.col("r.q.score"))
    place = F.greatest(*[F.abs(F.col(f"r.p.{c}") - F.col(f"r.q.{c}")) for c in "xywh"])
    outcome = F.when((score == 0) & (place == 0), "exact").when((score <= score_tolerance) & (place <= place_tolerance), "tolerant").otherwise("mismatch")
    return rows.select(*group, F.col("r.p.pos").alias("a_pos"), F.col("r.q.pos").alias("b_pos"), score.alias("score_diff"), F.when(F.col("r.p").isNotNull() & F.col("r.q").isNotNull(), place).alias("place_diff"), outcome.alias("outcome"))


def run_summary(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of a comparison of two runs (A33). pairs: the output of paired()."""
    found = F.col("a_pos").isNotNull() & F.col("b_pos").isNotNull()
    n = lambda c: F.count_if(c)
    return pairs.groupBy(*keys).agg(n(found).alias("matched"), n(F.col("outcome") == "exact").alias("exact"), n(F.col("outcome") == "tolerant").alias("tolerant"), n(F.col("outcome") == "mismatch").alias("mismatches"), n(F.col("b_pos").isNull()).alias("unmatched_current"), n(F.col("a_pos").isNull()).alias("unmatched_other"), F.coalesce(F.max("score_diff"), F.lit(0.0)).alias("max_score_diff"), F.coalesce(F.max("place_diff"), F.lit(0.0)).alias("max_place_diff"))
