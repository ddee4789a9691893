"""Reviewing runs: why boxes differ, what is near them, what was live when, and what limits and styles to suggest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .intervals import range_join
from .stats import at_ranks, nearest

BUCKET = 0.5


def _dealt(df: DataFrame, bucket: float) -> DataFrame:
    """A row for each time bucket that its span touches, so that a join in time is an equi-join."""
    return df.withColumn("_k", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("stop") / bucket))))


def causes(boxes: DataFrame, dropped: DataFrame, default: str = "tracking", bucket: float = BUCKET) -> DataFrame:
    """boxes with cause: the rule that dropped most detections of the box's label whose centre lies in the box while it is live, the first by name of equals; default if none.

    boxes: id, entity_id, class_id, start, stop and a box; dropped: entity_id, class_id, t, a box and rule.
    """
    points = dropped.select("entity_id", "class_id", "t", (F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy"), "rule")
    spans = boxes.select("entity_id", "class_id", "id", "start", "stop", *[F.col(c).alias(f"b{c}") for c in "xywh"])
    inside = F.col("cx").between(F.col("bx"), F.col("bx") + F.col("bw")) & F.col("cy").between(F.col("by"), F.col("by") + F.col("bh"))
    hits = range_join(points, spans, ["entity_id", "class_id"], "t", "start", "stop", bucket, extra=inside).groupBy("id", "rule").agg(F.count("*").alias("_n"))
    best = hits.groupBy("id").agg(F.min(F.struct(-F.col("_n"), F.col("rule")))["rule"].alias("_rule"))
    return boxes.join(best, "id", "left").withColumn("cause", F.coalesce("_rule", F.lit(default))).drop("_rule")


def cause_seconds(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Box seconds by cause, one decimal (A31). boxes: start, stop, cause."""
    return boxes.groupBy(*keys, "cause").agg(F.bround(F.sum(F.greatest(F.col("stop") - F.col("start"), F.lit(0.0))), 1).alias("seconds"))


def nearby(a: DataFrame, b: DataFrame, bucket: float = BUCKET) -> DataFrame:
    """Rows of a that some row of b of the same entity and label overlaps in time and in area, both strictly."""
    cols = ["entity_id", "class_id", "_k", "id", "start", "stop", *"xywh"]
    p = _dealt(a, bucket).select(*cols)
    q = _dealt(b, bucket).select(*[F.col(c).alias(c if c in cols[:3] else f"o_{c}") for c in cols])
    meets = F.col("start") < F.col("o_stop")
    for c in ("o_start < stop", "x < o_x + o_w", "o_x < x + w", "y < o_y + o_h", "o_y < y + h"):
        meets = meets & F.expr(c)
    return a.join(p.join(q, cols[:3]).where(meets).select("id").distinct(), "id", "left_semi")


def only_in_first(a: DataFrame, b: DataFrame, keys: list[str], bucket: float) -> DataFrame:
    """Spans of a that no span of b of the same keys overlaps, strictly (J19). Spans have id, start and stop."""
    p = _dealt(a, bucket).select(*keys, "_k", "id", "start", "stop")
    q = _dealt(b, bucket).select(*keys, "_k", F.col("start").alias("_s"), F.col("stop").alias("_e"))
    hits = p.join(q, [*keys, "_k"]).where("start < _e AND _s < stop").select("id").distinct()
    return a.join(hits, "id", "left_anti")


def live_history(grid: DataFrame, spans: DataFrame, keys: list[str], bucket: float = BUCKET) -> DataFrame:
    """For each instant of the grid how many spans hold it, ends included; instants without any are left out."""
    return range_join(grid, spans, keys, "t", "start", "stop", bucket).groupBy(*keys, "t").agg(F.count("*").alias("live"))


def live_state(start: Column, stop: Column, now: float) -> Column:
    """pending if it starts after now, live if it ends after now, else past."""
    return F.when(start > now, "pending").when(stop > now, "live").otherwise("past")


def motion_index(tracks: DataFrame, keys: list[str]) -> DataFrame:
    """Samples of tracks that have more than one, with their place in time."""
    of_track = W.partitionBy(*keys)
    return tracks.withColumns({"_n": F.count("*").over(of_track), "place": F.row_number().over(of_track.orderBy("t"))}).where("_n > 1").drop("_n")


def geometry_bounds(df: DataFrame, frame: float, widen: float = 1.1, least: int = 30) -> DataFrame:
    """Per label bounds of area share and aspect: the first percentile narrowed and the ninety-ninth widened, an area share at most 1; null below `least` rows (A10).
    Boxes without height have no aspect."""
    at = {"lo": nearest(0.01), "hi": nearest(0.99)}
    area = at_ranks(df.withColumn("_m", F.col("w") * F.col("h") / frame), ["class_id"], "_m", at)
    ratio = at_ranks(df.withColumn("_m", F.when(F.col("h") != 0, F.try_divide(F.col("w"), F.col("h")))), ["class_id"], "_m", at)
    enough = lambda c: F.when(F.col("n") >= least, c)
    a = area.select("class_id", "n", enough(F.bround(F.col("lo") / widen, 6)).alias("area_lo"), enough(F.bround(F.least(F.lit(1.0), F.col("hi") * widen), 6)).alias("area_hi"))
    r = ratio.select("class_id", F.bround(F.col("lo") / widen, 3).alias("_lo"), F.bround(F.col("hi") * widen, 3).alias("_hi"))
    return a.join(r, "class_id", "left").select("class_id", "n", "area_lo", "area_hi", enough(F.col("_lo")).alias("aspect_lo"), enough(F.col("_hi")).alias("aspect_hi"))


def hysteresis(df: DataFrame, floor: float, least: int = 30) -> DataFrame:
    """Per label thresholds to start and to continue (A11): the lower quartile of scores, at least floor + 0.01, and half way from the floor to it, at least floor + 0.005; three decimals, null below `least` rows."""
    s = at_ranks(df, ["class_id"], "score", {"p25": nearest(0.25)})
    start = F.bround(F.greatest(F.lit(floor + 0.01), F.col("p25")), 3)
    on = F.bround(F.greatest(F.lit(floor + 0.005), F.lit(floor) + (start - floor) / 2), 3)
    return s.select("class_id", "n", F.when(F.col("n") >= least, start).alias("start_at"), F.when(F.col("n") >= least, on).alias("continue_at"))


def bound_what_if(df: DataFrame, value: str, bounds: list[tuple[str, float]]) -> DataFrame:
    """For each label and candidate bound (kind max or min, value): rows beyond it, their share, least, median and greatest overshoot, and for a max the median linear shrink of a clamp.

    bounds is a list in the program."""
    n = df.groupBy("class_id").agg(F.count(value).alias("n"))
    each = df.select("class_id", F.col(value).alias("_v"), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(float(b)).alias("bound")) for k, b in bounds])).alias("c")).select("class_id", "_v", "c.*")
    bad = each.where(F.when(F.col("kind") == "max", F.col("_v") > F.col("bound")).otherwise(F.col("_v") < F.col("bound")))
    ratio = F.when(F.col("bound") != 0, F.try_divide(F.col("_v"), F.col("bound"))).otherwise(F.lit(0.0))
    r = at_ranks(bad.withColumn("_r", ratio), ["class_id", "kind", "bound"], "_r", {"median_over": nearest(0.5)})
    k = at_ranks(bad.where("kind = 'max' and _v > 0").withColumn("_s", F.sqrt(F.col("bound") / F.col("_v"))), ["class_id", "kind", "bound"], "_s", {"median_shrink": nearest(0.5)})
    every = n.select("class_id", "n", F.explode(F.array(*[F.struct(F.lit(x).alias("kind"), F.lit(float(b)).alias("bound")) for x, b in bounds])).alias("c")).select("class_id", "n", "c.*")
    keys = ["class_id", "kind", "bound"]
    out = every.join(r.select(*keys, F.col("n").alias("violates"), F.col("least").alias("least_over"), "median_over", F.col("most").alias("most_over")), keys, "left").join(k.select(*keys, "median_shrink"), keys, "left")
    return out.fillna(0, ["violates"]).withColumn("share", F.col("violates") / F.col("n"))


def style_draw(key: Column, styles: list[tuple[str, float]]) -> Column:
    """One weighted draw a key, the same in every run: the first eight hex digits of the key's MD5 as a share of the weights."""
    u = F.conv(F.left(F.md5(key), F.lit(8)), 16, 10).cast("double") / 4294967296.0 * sum(w for _, w in styles)
    pick, edge = F.lit(styles[-1][0]), sum(w for _, w in styles)
    for name, weight in reversed(styles):
        edge -= weight
        pick = F.when(u >= edge + weight, pick).otherwise(name)
    return pick


def top_by_share(df: DataFrame, key: str, part: Column, whole: Column, least: float, n: int) -> DataFrame:
    """The n keys with the largest share of part in whole among those with at least `least` of the whole, ties by key."""
    s = df.groupBy(key).agg(F.sum(part).alias("_p"), F.sum(whole).alias("_w")).where((F.col("_w") >= least) & (F.col("_p") > 0))
    return s.select(key, (F.col("_p") / F.col("_w")).alias("share")).orderBy(F.desc("share"), key).limit(n)


def resolved(df: DataFrame, key: str, tiers: list[dict[str, float]], default: float) -> Column:
    """The value of the first tier that has the key, from the most special one on; tiers are dictionaries of the program."""
    found = [F.element_at(F.create_map(*[F.lit(x) for kv in t.items() for x in kv]), F.col(key)) for t in tiers if t]
    return F.coalesce(*found, F.lit(default))


def whitelisted(tiers: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """Settings (tier, label, name, value) that their tier may set (P13): a tier without an entry may set any."""
    ok = F.lit(True)
    for tier, names in allowed.items():
        ok = ok & ((F.col("tier") != tier) | F.col("name").isin(*names))
    return tiers.where(ok)


def settings_of(tiers: DataFrame, order: list[str]) -> DataFrame:
    """One value a label and name: that of the last tier in order that sets it."""
    rank = F.array_position(F.array(*[F.lit(t) for t in order]), F.col("tier"))
    return tiers.where(rank > 0).groupBy("label", "name").agg(F.max_by("value", rank).alias("value"), F.max_by("tier", rank).alias("tier"))


def top_by(df: DataFrame, name: str, value: str, n: int) -> DataFrame:
    """The n rows with the largest value, ties by name, zeros left out (O2, O3)."""
    return df.where(F.col(value) > 0).orderBy(F.desc(value), name).limit(n)


def distinct_top(df: DataFrame, name: str, value: str, content: str, n: int) -> DataFrame:
    """The n rows with the largest value among the first of each content (O5); null content is like no other."""
    first = W.partitionBy(content).orderBy(F.desc(value), name)
    d = df.where(F.col(value) > 0).withColumn("_r", F.row_number().over(first)).where(F.col(content).isNull() | (F.col("_r") == 1)).drop("_r")
    return d.orderBy(F.desc(value), name).limit(n)


def top_windows(events: DataFrame, durations: DataFrame, length: float, count: int) -> DataFrame:
    """Per entity up to count windows of `length` seconds that hold most box seconds and don't overlap, by weight and then start.

    events: entity_id, start, stop; durations: entity_id, duration. Each event's middle proposes a window around it; what its window holds is a
    range sum over the sorted middles; the choice is a fold over the candidates by weight.
    """
    e = events.join(durations.where("duration > 0"), "entity_id").select("entity_id", "duration", ((F.col("start") + F.col("stop")) / 2).alias("m"), F.greatest(F.col("stop") - F.col("start"), F.lit(0.0)).alias("w"), F.least(F.lit(float(length)), F.col("duration")).alias("len"))
    e = e.withColumn("at", F.greatest(F.lit(0.0), F.least(F.col("m") - F.col("len") / 2, F.col("duration") - F.col("len"))))
    # sums of the middles before a bound, found among middles and bounds in one order; a bound comes before a middle of the same time
    mids = e.select("entity_id", F.col("m").alias("v"), F.lit(1).alias("o"), "w", F.lit(None).cast("double").alias("at"), F.lit(0).alias("side"))
    ends = [e.select("entity_id", c.alias("v"), F.lit(0).alias("o"), F.lit(0.0).alias("w"), "at", F.lit(k).alias("side")).distinct() for k, c in ((1, F.col("at")), (2, F.col("at") + F.col("len")))]
    order = W.partitionBy("entity_id").orderBy("v", "o").rowsBetween(W.unboundedPreceding, 0)
    sums = mids.unionByName(ends[0]).unionByName(ends[1]).withColumn("sum", F.sum("w").over(order)).where("side > 0")
    weight = sums.groupBy("entity_id", "at").agg((F.max(F.when(F.col("side") == 2, F.col("sum"))) - F.max(F.when(F.col("side") == 1, F.col("sum")))).alias("weight")).where("weight > 0")
    len_of = durations.select("entity_id", F.least(F.lit(float(length)), F.col("duration")).alias("len"))
    all_ = weight.groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("k"), "at"))).alias("all")).join(len_of, "entity_id")  # one entity's events
    free = "not exists(acc, q -> q < r.at + len and r.at < q + len)"
    chosen = F.expr(f"aggregate(all, cast(array() as array<double>), (acc, r) -> if(size(acc) < {count} and {free}, concat(acc, array(r.at)), acc))")
    return all_.select("entity_id", "len", F.explode(F.array_sort(chosen)).alias("start")).select("entity_id", "start", (F.col("start") + F.col("len")).alias("stop"))
