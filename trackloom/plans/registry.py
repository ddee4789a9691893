"""Queries by name, and the DuckDB SQL that states the same. Doubles are rounded on both sides, since sums depend on order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import boxes as B
from ..operators import catalog, diff, intervals, review, runs, stages, stats, structure, tensor, tracking
from ..sources.detections import DET_SQL, EV_SQL, detections, sample_times, table, timeline
from ..streaming import live

RULES = [("label_a", "label_b", 0.3, 0.1), ("label_c", "label_b", 0.4, 0.2)]
FRAME = 500.0 * 460.0
PROFILES = [structure.Profile("mixed", 0.002), structure.Profile("busy", 0.0025, fps=18.0), structure.Profile("hand", 0.0001, manual=True), structure.Profile("calm")]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_IX = "greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0)"
_IY = "greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0)"
_IOU = f"({_IX} * {_IY} / (a.w * a.h + b.w * b.h - {_IX} * {_IY}))"
_SAME = "a.entity_id = b.entity_id AND a.sample_index = b.sample_index"


def query(sql: str | None = None, source: str = "det"):
    """Register a query under its function's name, with its SQL over det or ev."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            head = {"det": f"WITH {DET_SQL}", "ev": f"WITH {EV_SQL}", "": ""}[source]
            text = f"{head} {sql}" if not sql.startswith(",") else f"{head}{sql}"
            ORACLE_SQL[f.__name__] = text.replace("WITH ", "WITH RECURSIVE ", 1).replace("RECURSIVE_ ", "") if "RECURSIVE_ " in text else text
        return f

    return put


def r6(c) -> object:
    return F.round(c, 6)


@query(f"""SELECT l.class_id, count(*) AS n, count(s.pos) AS suppressed FROM det l LEFT JOIN (SELECT DISTINCT a.entity_id, a.sample_index, a.pos FROM det a JOIN det b ON {_SAME} AND a.pos <> b.pos
 AND ((a.class_id = 'label_a' AND b.class_id = 'label_b' AND {_IOU} >= 0.3 AND b.score - a.score >= 0.1) OR (a.class_id = 'label_c' AND b.class_id = 'label_b' AND {_IOU} >= 0.4 AND b.score - a.score >= 0.2))) s
 ON l.entity_id = s.entity_id AND l.sample_index = s.sample_index AND l.pos = s.pos GROUP BY 1""")
def suppress_counts(spark, sf):
    out = stages.suppressed(detections(spark, sf), RULES)
    return out.groupBy("class_id").agg(F.count("*").alias("n"), F.count("by_pos").alias("suppressed"))


@query(f""", f AS (SELECT a.entity_id, a.sample_index, a.pos, coalesce(bool_or(b.class_id = 'label_c' AND {_IOU} >= 0.5), false) AS has_t, coalesce(bool_or(b.class_id = 'label_b' AND b.score >= 0.2 AND {_IX} * {_IY} / (a.w * a.h) >= 0.3), false) AS has_e
 FROM det a LEFT JOIN det b ON {_SAME} AND a.pos <> b.pos WHERE a.class_id = 'label_a' AND a.score >= 0.4 GROUP BY 1, 2, 3)
 SELECT class_id, CASE WHEN f.pos IS NULL THEN 'not_judged' WHEN has_t THEN 'already_covered' WHEN has_e THEN 'promoted' ELSE 'no_evidence' END AS outcome, count(*) AS n, sum(sample_index * 10 + pos)::BIGINT AS rows FROM det LEFT JOIN f USING (entity_id, sample_index, pos) GROUP BY 1, 2""")
def promote_labels(spark, sf):
    out = stages.promoted(detections(spark, sf), [stages.Promotion("label_a", "label_c", 0.4, 0.5, (stages.Evidence("label_b", 0.2, min_source_overlap=0.3),))])
    return out.groupBy("class_id", F.coalesce("outcome", F.lit("not_judged")).alias("outcome")).agg(F.count("*").alias("n"), F.sum(F.col("sample_index") * 10 + F.col("pos")).alias("rows"))


@query(f""", g AS (SELECT *, CASE WHEN w * h / {FRAME} < 0.02 THEN 'too_small' WHEN w * h / {FRAME} > 0.15 THEN 'too_large' WHEN coalesce(w / nullif(h, 0), 0) < 0.6 THEN 'too_tall' WHEN coalesce(w / nullif(h, 0), 0) > 2.5 THEN 'too_wide' ELSE 'none' END AS reason FROM det),
 c AS (SELECT *, greatest(1, least(500, CASE reason WHEN 'too_large' THEN w * sqrt(0.15 * {FRAME} / (w * h)) WHEN 'too_wide' THEN h * 2.5 ELSE w END)) AS nw, greatest(1, least(460, CASE reason WHEN 'too_large' THEN h * sqrt(0.15 * {FRAME} / (w * h)) ELSE h END)) AS nh FROM g)
 SELECT class_id, reason, CASE reason WHEN 'too_small' THEN 'drop' WHEN 'too_tall' THEN 'drop' WHEN 'none' THEN 'keep' ELSE 'clamp' END AS action, count(*) AS n, round(sum(CASE WHEN reason IN ('too_large', 'too_wide') THEN nw ELSE w END), 3) AS width,
 round(sum(CASE WHEN reason IN ('too_large', 'too_wide') THEN greatest(0, least(x + w / 2 - nw / 2, 500 - nw)) ELSE x END), 3) AS left_edge, round(sum(CASE WHEN reason IN ('too_large', 'too_wide') THEN greatest(0, least(y + h / 2 - nh / 2, 460 - nh)) ELSE y END), 3) AS top_edge FROM c GROUP BY 1, 2, 3""")
def geometry_actions(spark, sf):
    out = detections(spark, sf).withColumn("reason", B.geometry_reason(FRAME, 0.02, 0.15, 0.6, 2.5))
    out = out.withColumns(B.clamped(F.col("reason"), 500, 460, 0.15, 2.5))
    sums = [F.round(F.sum(c), 3).alias(n) for n, c in (("width", "cw"), ("left_edge", "cx"), ("top_edge", "cy"))]
    return out.groupBy("class_id", F.coalesce("reason", F.lit("none")).alias("reason"), B.geometry_action(F.col("reason")).alias("action")).agg(F.count("*").alias("n"), *sums)


@query("""SELECT class_id, score <= p AND c IS NOT NULL AS provisional, count(*) AS n, round(sum(greatest(t - 0.15, 0)), 3) AS starts, round(sum(t + 0.15), 3) AS stops
 FROM det JOIN (VALUES ('label_a', 0.5, 0.3), ('label_b', 0.6, NULL)) s(class_id, p, c) USING (class_id) WHERE score > least(p, coalesce(c, p)) GROUP BY 1, 2""")
def entry_gate(spark, sf):
    out = stages.entry_gate(detections(spark, sf), [("label_a", 0.5, 0.3), ("label_b", 0.6, None)], 0.3)
    return out.groupBy("class_id", "provisional").agg(F.count("*").alias("n"), F.round(F.sum("start"), 3).alias("starts"), F.round(F.sum("stop"), 3).alias("stops"))


@query("""SELECT class_id, sum(least(floor(greatest(0, x - w * 0.2 / 2)), 499))::BIGINT AS px, sum(greatest(1, ceil(least(500 - least(floor(greatest(0, x - w * 0.2 / 2)), 499), w * 1.2))))::BIGINT AS pw,
 sum(least(floor(greatest(0, y - h * 0.2 / 2)), 459))::BIGINT AS py, sum(greatest(1, ceil(least(460 - least(floor(greatest(0, y - h * 0.2 / 2)), 459), h * 1.2))))::BIGINT AS ph FROM det GROUP BY 1""")
def padded_boxes(spark, sf):
    out = detections(spark, sf).withColumns(B.padded(0.2, 500, 460))
    return out.groupBy("class_id").agg(*[F.sum(c).alias(c) for c in ("px", "pw", "py", "ph")])


@query(f"""SELECT a.class_id, count(*) AS pairs, count(*) FILTER ({_IOU} >= 0.6) AS alike, round(avg({_IOU}), 6) AS mean_iou FROM det a JOIN det b ON {_SAME} AND a.pos < b.pos AND a.class_id = b.class_id AND a.size <> b.size GROUP BY 1""")
def cross_size_pairs(spark, sf):
    return stages.cross_size_pairs(detections(spark, sf)).groupBy(F.col("a_class_id").alias("class_id")).agg(F.count("*").alias("pairs"), F.count_if(F.col("iou") >= 0.6).alias("alike"), r6(F.avg("iou")).alias("mean_iou"))


@query(f""", RECURSIVE_ o AS (SELECT *, row_number() OVER (PARTITION BY entity_id, sample_index, class_id ORDER BY score DESC, pos) AS k FROM det),
 e AS (SELECT a.entity_id, a.sample_index, a.class_id, a.k AS loser, b.k AS winner FROM o a JOIN o b ON {_SAME} AND a.class_id = b.class_id AND a.k > b.k AND a.size <> b.size AND {_IOU} >= 0.3),
 l AS (SELECT entity_id, sample_index, class_id, loser AS k, list(winner) AS ws FROM e GROUP BY 1, 2, 3, 4),
 s AS (SELECT o.entity_id, o.sample_index, o.class_id, o.k, coalesce(l.ws, []) AS ws FROM o LEFT JOIN l ON o.entity_id = l.entity_id AND o.sample_index = l.sample_index AND o.class_id = l.class_id AND o.k = l.k),
 r AS (SELECT entity_id, sample_index, class_id, k, [k] AS alive FROM s WHERE k = 1
 UNION ALL SELECT s.entity_id, s.sample_index, s.class_id, s.k, CASE WHEN len(list_intersect(s.ws, r.alive)) > 0 THEN r.alive ELSE list_append(r.alive, s.k) END FROM r JOIN s ON s.entity_id = r.entity_id AND s.sample_index = r.sample_index AND s.class_id = r.class_id AND s.k = r.k + 1),
 f AS (SELECT class_id, arg_max(len(alive), k) AS kept FROM r GROUP BY entity_id, sample_index, class_id)
 SELECT class_id, sum(kept)::BIGINT AS kept FROM f GROUP BY 1""")
def cross_size_dedup(spark, sf):
    return stages.cross_size_dedup(detections(spark, sf), 0.3).groupBy("class_id").agg(F.count("*").alias("kept"))


@query(f"""SELECT a.class_id AS a, b.class_id AS b, count(*) AS n, round(avg({_IOU}), 6) AS mean_iou, round(median(a.score - b.score), 6) AS margin, round(avg(least(a.w * a.h, b.w * b.h) / greatest(a.w * a.h, b.w * b.h)), 6) AS ratio
 FROM det a JOIN det b ON {_SAME} AND a.pos <> b.pos WHERE {_IOU} > 0 GROUP BY 1, 2""")
def pair_iou_stats(spark, sf):
    p = stages.same_instant_pairs(detections(spark, sf)).where("iou > 0")
    a, b = B.area("a_"), B.area("b_")
    p = p.select(F.col("a_class_id").alias("a"), F.col("b_class_id").alias("b"), "iou", (F.col("a_score") - F.col("b_score")).alias("margin"), (F.least(a, b) / F.greatest(a, b)).alias("ratio"))
    means = p.groupBy("a", "b").agg(F.count("*").alias("n"), r6(F.avg("iou")).alias("mean_iou"), r6(F.avg("ratio")).alias("ratio"))
    mid = stats.at_ranks(p, ["a", "b"], "margin", {"_lo": lambda n: F.floor((n - 1) / 2), "_hi": lambda n: F.floor(n / 2)})
    return means.join(mid.select("a", "b", r6((F.col("_lo") + F.col("_hi")) / 2).alias("margin")), ["a", "b"])


@query(""", s AS (SELECT class_id, list_sort(list(score)) AS v, round(avg(score), 6) AS mean_v, round(median(score), 6) AS median_v FROM det GROUP BY 1)
 SELECT class_id, len(v) AS n, v[1] AS min_v, v[len(v)] AS max_v, mean_v, median_v, v[round_even(0.01 * (len(v) - 1), 0)::INT + 1] AS p1, v[round_even(0.25 * (len(v) - 1), 0)::INT + 1] AS p25, v[round_even(0.75 * (len(v) - 1), 0)::INT + 1] AS p75,
 v[round_even(0.99 * (len(v) - 1), 0)::INT + 1] AS p99, v[least(len(v) - 1, floor(len(v) * 0.9)::INT) + 1] AS p90_floor, v[len(v) // 2 + 1] AS upper_median FROM s""")
def score_describe(spark, sf):
    return stats.describe(detections(spark, sf), ["class_id"], "score").withColumns({c: r6(c) for c in ("mean_v", "median_v")})


@query("SELECT class_id, round(quantile_cont(score, 0.1), 6) AS q10, round(quantile_cont(score, 0.5), 6) AS q50, round(quantile_cont(score, 0.9), 6) AS q90 FROM det GROUP BY 1")
def score_percentiles(spark, sf):
    return stats.percentiles(detections(spark, sf), ["class_id"], "score", (0.1, 0.5, 0.9)).withColumns({c: r6(c) for c in ("q10", "q50", "q90")})


@query("""SELECT k.class_id, b.bucket::INT AS bucket, count(d.score) AS n FROM (SELECT DISTINCT class_id FROM det) k CROSS JOIN range(20) b(bucket)
 LEFT JOIN det d ON d.class_id = k.class_id AND least(greatest(floor(d.score / 0.05), 0), 19) = b.bucket GROUP BY 1, 2""")
def score_histogram(spark, sf):
    return stats.histogram(detections(spark, sf), ["class_id"], "score", 0.0, 1.0, 20)


@query("SELECT class_id, round(avg(CASE WHEN score < 0.35 THEN 1.0 ELSE 0.0 END), 6) AS below FROM det GROUP BY 1")
def score_below(spark, sf):
    return stats.below_share(detections(spark, sf), ["class_id"], "score", 0.35).withColumn("below", r6("below"))


@query("SELECT entity_id, class_id, round_even(count(DISTINCT sample_index) / 10.0, 1)::DOUBLE AS seconds FROM det WHERE score >= 0.5 GROUP BY 1, 2")
def label_seconds(spark, sf):
    return stats.label_seconds(detections(spark, sf), 10.0)


@query(""", s AS (SELECT DISTINCT entity_id, sample_index, class_id FROM det WHERE score >= 0.5)
 SELECT a.entity_id, a.class_id AS a, b.class_id AS b, round_even(count(*) / 10.0, 1)::DOUBLE AS seconds FROM s a JOIN s b ON a.entity_id = b.entity_id AND a.sample_index = b.sample_index AND a.class_id < b.class_id GROUP BY 1, 2, 3""")
def pair_seconds(spark, sf):
    return stats.pair_seconds(detections(spark, sf), 10.0)


@query(""", c AS (SELECT entity_id, floor(round_even(t * 10, 0) / 100)::BIGINT AS bucket, count(*) AS n FROM det WHERE score >= 0.5 AND class_id IN ('label_a', 'label_b') GROUP BY 1, 2), m AS (SELECT entity_id, unnest(range(max(bucket) + 1)) AS bucket FROM c GROUP BY entity_id)
 SELECT entity_id, bucket, round_even(coalesce(n, 0) / 100.0, 3)::DOUBLE AS boxes FROM m LEFT JOIN c USING (entity_id, bucket)""")
def box_timeline(spark, sf):
    return stats.box_timeline(detections(spark, sf), 10.0, ["label_a", "label_b"])


_CUTS = """, c AS (SELECT entity_id, t, lag(t, 1, 0.0) OVER (PARTITION BY entity_id ORDER BY t) AS before FROM ev),
 s AS (SELECT entity_id, t - before AS span FROM c UNION ALL SELECT entity_id, 2678400.0 - max(t) FROM ev GROUP BY 1)"""


def _cut_signals(spark, sf):
    return structure.signals(structure.cut_arrays(timeline(spark, sf)).withColumn("seconds", F.lit(2678400.0)))


@query(_CUTS + """ SELECT entity_id, (SELECT count(*) FROM ev WHERE ev.entity_id = s.entity_id) AS cut_count, 2678400.0 AS scanned_seconds, round(60.0 * (SELECT count(*) FROM ev WHERE ev.entity_id = s.entity_id) / 2678400.0, 6) AS cuts_per_min,
 round(coalesce(sum(span) FILTER (span < 1), 0) / sum(span), 6) AS short_shot_fraction, round(median(span), 6) AS median_shot_seconds FROM s WHERE span > 0 GROUP BY 1""", "ev")
def structure_signals(spark, sf):
    return _cut_signals(spark, sf).withColumns({c: r6(c) for c in ("cuts_per_min", "short_shot_fraction", "median_shot_seconds")})


@query(""", p AS (SELECT entity_id, 60.0 * count(*) / 2678400.0 AS v FROM ev GROUP BY 1) SELECT entity_id, CASE WHEN v >= 0.0025 THEN 'busy' WHEN v >= 0.002 THEN 'mixed' ELSE 'calm' END AS profile, CASE WHEN v >= 0.0025 THEN 18.0 ELSE 10.0 END::DOUBLE AS fps FROM p""", "ev")
def profile_pick(spark, sf):
    out = structure.pick_profile(_cut_signals(spark, sf), PROFILES, None)
    return out.select("entity_id", "profile", structure.sample_rate(F.col("profile"), PROFILES, 10.0).alias("fps"))


@query(""", a AS (SELECT *, CASE WHEN t - lag(t) OVER o < 20000 - 1e-6 THEN 0 ELSE 1 END AS new FROM ev WINDOW o AS (PARTITION BY entity_id ORDER BY t)), b AS (SELECT *, sum(new) OVER (PARTITION BY entity_id ORDER BY t) AS k FROM a),
 c AS (SELECT entity_id, k, count(*) AS n, max(t) - min(t) AS span FROM b GROUP BY 1, 2)
 SELECT entity_id, count(*) FILTER (n > 1 AND span <= 60000 + 1e-6) AS bursts, coalesce(sum(n) FILTER (n > 1 AND span <= 60000 + 1e-6), 0)::BIGINT AS cuts_in_bursts, coalesce(max(n) FILTER (n > 1 AND span <= 60000 + 1e-6), 0) AS longest FROM c GROUP BY 1""", "ev")
def burst_census(spark, sf):
    b = intervals.bursts(timeline(spark, sf), "entity_id", 20000.0, 60000.0)
    n = F.when(F.col("burst"), F.col("n"))
    return b.groupBy("entity_id").agg(F.count_if("burst").alias("bursts"), F.coalesce(F.sum(n), F.lit(0)).alias("cuts_in_bursts"), F.coalesce(F.max(n), F.lit(0)).alias("longest"))


_TRIG = """, i AS (SELECT entity_id, greatest(t - 5000, 0) AS s, t + 12000 AS e FROM ev), m AS (SELECT *, max(e) OVER (PARTITION BY entity_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM i),
 n AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m), u AS (SELECT entity_id, min(s) AS start, max(e) AS stop, count(*) AS n FROM n GROUP BY entity_id, k)"""


@query(_TRIG + " SELECT entity_id, round(start, 3) AS start, round(stop, 3) AS stop, n FROM u", "ev")
def trigger_intervals(spark, sf):
    out = intervals.triggers(timeline(spark, sf), ["entity_id"], 5000.0, 12000.0)
    return out.select("entity_id", F.round("start", 3).alias("start"), F.round("stop", 3).alias("stop"), "n")


@query(_TRIG + """, g AS (SELECT k.entity_id, (b.x * 3600.0)::DOUBLE AS t FROM (SELECT DISTINCT entity_id FROM ev) k CROSS JOIN range(24 * 30) b(x)),
 h AS (SELECT g.*, (SELECT max(stop) FROM u WHERE u.entity_id = g.entity_id AND u.start <= g.t) AS stop, (SELECT min(start) FROM u WHERE u.entity_id = g.entity_id AND u.start > g.t) AS nxt FROM g)
 SELECT entity_id, round(sum(greatest(coalesce(CASE WHEN t <= stop THEN 1.0 ELSE greatest(1 - (t - stop) / 9000, 0) END, 0), coalesce(greatest(1 - (nxt - t) / 9000, 0), 0))), 4) AS opacity FROM h GROUP BY 1""", "ev")
def opacity_at(spark, sf):
    ev = timeline(spark, sf)
    grid = ev.select("entity_id").distinct().select("entity_id", F.explode(F.sequence(F.lit(0), F.lit(24 * 30 - 1))).alias("x")).select("entity_id", (F.col("x") * 3600.0).cast("double").alias("t"))
    return intervals.opacity(grid, intervals.triggers(ev, ["entity_id"], 5000.0, 12000.0), ["entity_id"], 9000.0).groupBy("entity_id").agg(F.round(F.sum("opacity"), 4).alias("opacity"))


def _single_tracks(spark, sf):
    v = F.col("value")
    ev = timeline(spark, sf).select("entity_id", F.lit("one").alias("class_id"), "t", F.col("t").alias("start"), F.col("t").alias("stop"), *[F.lit(c).cast("double").alias(n) for n, c in (("x", 100), ("y", 50))], F.least(v, F.lit(90.0)).alias("w"), F.lit(100.0).alias("h"), F.lit(0.9).alias("score"), F.lit(0).alias("pos"), F.lit(False).alias("provisional"))
    return tracking.track(ev, tracking.Settings(max_gap=30000.0, reach=100.0, alpha=1.0, alpha_size=1.0, step=1.0, interpolate=0.0, min_hits=2))


@query(""", a AS (SELECT *, CASE WHEN t - lag(t) OVER o <= 30000 THEN 0 ELSE 1 END AS new FROM ev WINDOW o AS (PARTITION BY entity_id ORDER BY t)), b AS (SELECT *, sum(new) OVER (PARTITION BY entity_id ORDER BY t) AS k FROM a),
 c AS (SELECT entity_id, k, count(*) AS n, sum(trunc(least(value, 90.0)))::BIGINT AS w FROM b GROUP BY 1, 2 HAVING count(*) >= 2) SELECT entity_id, count(*) AS tracks, sum(n)::BIGINT AS boxes, sum(w)::BIGINT AS width FROM c GROUP BY 1""", "ev")
def track_single(spark, sf):
    t = _single_tracks(spark, sf)
    return t.groupBy("entity_id").agg(F.countDistinct("segment", "track").alias("tracks"), F.count("*").alias("boxes"), F.sum(F.col("w").cast("long")).alias("width"))


@query()
def track_multi(spark, sf):
    det = stages.entry_gate(detections(spark, sf), [("label_a", 0.5, 0.3), ("label_b", 0.6, None), ("label_c", 0.4, 0.2)], 0.3)
    cuts = timeline(spark, sf).where("entity_id < 16").groupBy("entity_id").agg(F.sort_array(F.collect_list(F.col("t") / 1000)).alias("cuts"))
    t = tracking.track(det, tracking.Settings(max_gap=0.6, min_hits=2, confirm_score=0.8), cuts)
    return t.groupBy("entity_id", "class_id").agg(F.count_distinct("segment", "track").alias("tracks"), F.count("*").alias("boxes"), F.count_if("interpolated").alias("interpolated"))


@query(""", w AS (SELECT entity_id, t, value, lag(value) OVER (PARTITION BY entity_id ORDER BY t) AS p FROM ev) SELECT entity_id, count(*) AS n, round(avg(abs(value - p) / 2), 6) AS moved FROM w WHERE p IS NOT NULL GROUP BY 1""", "ev")
def jitter(spark, sf):
    t = timeline(spark, sf).select("entity_id", *[F.lit(1).alias(c) for c in ("class_id", "segment", "track", "pos")], "t", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("value").alias("w"), F.lit(10.0).alias("h"))
    return tracking.jitter(t).where("moved is not null").groupBy("entity_id").agg(F.count("*").alias("n"), r6(F.avg("moved")).alias("moved"))


@query(""", w AS (SELECT entity_id, max(value) OVER (PARTITION BY entity_id ORDER BY t RANGE BETWEEN 40000 PRECEDING AND 40000 FOLLOWING) AS m FROM ev) SELECT entity_id, round(sum(m), 3) AS widths FROM w GROUP BY 1""", "ev")
def size_window_max(spark, sf):
    t = timeline(spark, sf).select("entity_id", "t", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("value").alias("w"), F.lit(1.0).alias("h"))
    return tracking.stabilised(t, ["entity_id"], 40000.0).groupBy("entity_id").agg(F.round(F.sum("sw"), 3).alias("widths"))


@query(""", p AS (SELECT entity_id, t, value, lead(t) OVER o AS t2, lead(value) OVER o AS v2 FROM ev WINDOW o AS (PARTITION BY entity_id ORDER BY t)),
 g AS (SELECT *, unnest(range(ceil(t / 3600)::BIGINT, ceil(t2 / 3600)::BIGINT)) AS i FROM p WHERE t2 - t <= 20000 AND t2 > t)
 SELECT entity_id, count(*) AS n, sum(round_even(value + (v2 - value) * ((i * 3600.0 - t) / (t2 - t)), 0))::BIGINT AS v FROM g GROUP BY 1""", "ev")
def resample_grid(spark, sf):
    out = tracking.resampled(timeline(spark, sf), ["entity_id"], 1 / 3600, 20000.0, "value")
    return out.groupBy("entity_id").agg(F.count("*").alias("n"), F.sum("v").alias("v"))


@query(""", c AS (SELECT entity_id, class_id, sum(w * h) FILTER (score > 0.3) AS before, coalesce(sum(w * h) FILTER (score > 0.5), 0) AS after FROM det GROUP BY 1, 2) SELECT entity_id, class_id, round((after - before) / before, 6) AS change FROM c WHERE before > 0""")
def coverage_change(spark, sf):
    d = detections(spark, sf)
    cover = lambda least: d.where(F.col("score") > least).groupBy("entity_id", "class_id").agg(F.sum(B.area()).alias("v"))
    return diff.coverage_change(cover(0.3), cover(0.5), ["entity_id", "class_id"], "v").select("entity_id", "class_id", r6("change").alias("change"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1", "")
def newest_per_group(spark, sf):
    return catalog.newest(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("""WITH r AS (SELECT o_custkey, date_trunc('month', o_orderdate) AS m, max(o_orderdate) AS newest FROM orders GROUP BY 1, 2 HAVING count(DISTINCT o_orderstatus) >= 2)
 SELECT o_custkey, strftime(m, '%Y-%m') AS run FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY newest DESC, m DESC) AS k FROM r) WHERE k = 1""", "")
def complete_sets(spark, sf):
    o = table(spark, sf, "orders").withColumn("run", F.date_format("o_orderdate", "yyyy-MM"))
    return catalog.complete_sets(o, "o_custkey", "run", "o_orderstatus", 2, "o_orderdate").select("o_custkey", "run")


@query("SELECT o_orderpriority, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS parts, count(*) AS files FROM orders GROUP BY 1", "")
def configurations(spark, sf):
    return catalog.configurations(table(spark, sf, "orders"), ["o_orderpriority"], "o_orderstatus")


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS runs, round(sum(o_totalprice), 2) AS total, string_agg(DISTINCT (o_custkey % 5)::VARCHAR, ',' ORDER BY (o_custkey % 5)::VARCHAR) AS labels FROM orders GROUP BY 1, 2""", "")
def run_rollup(spark, sf):
    out = runs.rollup(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], {"total": F.col("o_totalprice")}, (F.col("o_custkey") % 5).cast("string"))
    return out.withColumn("total", F.round("total", 2))


@query("""WITH w AS (SELECT o_orderstatus, date_trunc('week', o_orderdate)::DATE AS week, count(*) AS runs, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2), n AS (SELECT *, count(*) OVER (PARTITION BY o_orderstatus) AS k FROM w)
 SELECT o_orderstatus, strftime(week, '%Y-%m-%d') AS week, runs, total FROM n WHERE k >= 2""", "")
def by_week(spark, sf):
    out = runs.by_week(table(spark, sf, "orders"), ["o_orderstatus"], "o_orderdate", "o_totalprice")
    return out.select("o_orderstatus", F.date_format("week", "yyyy-MM-dd").alias("week"), "runs", F.round("total", 2).alias("total"))


@query("SELECT o_orderstatus, round(sum(o_totalprice) FILTER (o_orderkey % 3 > 0) / nullif(sum(o_custkey) FILTER (o_orderkey % 3 > 0), 0), 6) AS cost, count(*) FILTER (o_orderkey % 3 = 0) AS reused FROM orders GROUP BY 1", "")
def cost_per_minute(spark, sf):
    o = table(spark, sf, "orders").withColumns({"minutes": F.col("o_custkey").cast("double"), "was_reused": F.col("o_orderkey") % 3 == 0})
    return runs.cost_per_minute(o, ["o_orderstatus"], "o_totalprice", "minutes", "was_reused").withColumn("cost", r6("cost"))


@query("""WITH c AS (SELECT l_returnflag AS k, l_suppkey FROM lineitem), n AS (SELECT count(DISTINCT k) AS n FROM c) SELECT l_suppkey FROM c GROUP BY 1 HAVING count(DISTINCT k) = (SELECT n FROM n)""", "")
def in_every_configuration(spark, sf):
    return diff.in_every(table(spark, sf, "lineitem"), "l_suppkey", "l_returnflag")


@query("""WITH c AS (SELECT o_custkey AS k, sum(o_totalprice) AS d, count(*)::DOUBLE AS m FROM orders GROUP BY 1) SELECT a.k AS a_k, b.k AS b_k FROM c a JOIN c b ON a.k < b.k AND a.d > 0 AND b.d > 0 AND abs(a.d - b.d) <= 0.002 * greatest(a.d, b.d) AND abs(a.m - b.m) <= greatest(0.06 * greatest(a.m, b.m), 2.0)""", "")
def near_duplicate_runs(spark, sf):
    c = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.sum("o_totalprice").alias("d"), F.count("*").cast("double").alias("m"))
    return catalog.near_duplicates(c, "k", "d", ["m"], 0.002)


_H = "list_transform(embedding, lambda x: abs(x::DOUBLE) / list_sum(list_transform(embedding, lambda y: abs(y::DOUBLE))))"
_D = lambda a, b: f"sqrt(greatest(1 - list_sum(list_transform(range(1, len({a}) + 1), lambda i: sqrt({a}[i] * {b}[i]))), 0))"


@query(f"""WITH h AS (SELECT vec_id, label, {_H} AS h FROM embeddings), w AS (SELECT *, lag(h) OVER o AS p, lag(h, 2) OVER o AS pp, lead(h) OVER o AS nx FROM h WINDOW o AS (PARTITION BY label ORDER BY vec_id))
 SELECT label, count(*) AS cuts, sum(vec_id)::BIGINT AS ids FROM w WHERE pp IS NOT NULL AND {_D('h', 'p')} >= 0.38 AND {_D('h', 'pp')} >= 0.38 AND (nx IS NULL OR {_D('nx', 'pp')} >= 0.38) GROUP BY 1""", "")
def cut_detector(spark, sf):
    h = table(spark, sf, "embeddings").select(F.col("label").alias("entity_id"), F.col("vec_id").alias("t"), tensor.normalised(F.col("embedding")).alias("hist"))
    return tensor.cuts(h, 0.38).groupBy(F.col("entity_id").alias("label")).agg(F.count("*").alias("cuts"), F.sum("t").alias("ids"))


@query(""", a AS (SELECT * FROM ev WHERE label = 'purchase'), b AS (SELECT * FROM ev WHERE label <> 'purchase')
 SELECT entity_id, count(*) AS n FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.entity_id = a.entity_id AND a.t < b.t + 3000 AND b.t < a.t + 3000) GROUP BY 1""", "ev")
def events_only_in_first(spark, sf):
    spans = timeline(spark, sf).select(F.col("event_id").alias("id"), "entity_id", "label", F.col("t").alias("start"), (F.col("t") + 3000).alias("stop"))
    return review.only_in_first(spans.where("label = 'purchase'"), spans.where("label <> 'purchase'"), ["entity_id"], 6000.0).groupBy("entity_id").agg(F.count("*").alias("n"))


def _side(spark, sf, size: int | None = None):
    """Boxes of all detections, or of one size: the sides of a comparison by a column of the table."""
    d = detections(spark, sf) if size is None else detections(spark, sf).where(F.col("size") == size)
    return d.select((F.col("sample_index") * 16000 + F.col("entity_id") * 1000 + F.col("pos")).alias("id"), "entity_id", "class_id", (F.col("t") - 0.2).alias("start"), (F.col("t") + 0.2).alias("stop"), "x", "y", "w", "h")


_SIZES = """, a AS (SELECT sample_index * 16000 + entity_id * 1000 + pos AS id, * FROM det WHERE size = 320), b AS (SELECT sample_index * 16000 + entity_id * 1000 + pos AS id, * FROM det WHERE size = 640),"""


@query(f"""{_SIZES} h AS (SELECT a.id AS ai, b.id AS bi FROM a JOIN b ON a.entity_id = b.entity_id AND a.class_id = b.class_id AND a.sample_index BETWEEN b.sample_index - 5 AND b.sample_index + 5 AND a.t - 0.2 <= b.t + 0.2 AND b.t - 0.2 <= a.t + 0.2 AND {_IOU} >= 0.3),
 l AS (SELECT entity_id, count(*) FILTER (id IN (SELECT ai FROM h)) AS in_both, count(*) FILTER (id NOT IN (SELECT ai FROM h)) AS current_only FROM a GROUP BY 1), r AS (SELECT entity_id, count(*) FILTER (id NOT IN (SELECT bi FROM h)) AS proposed_only FROM b GROUP BY 1)
 SELECT coalesce(l.entity_id, r.entity_id) AS entity_id, coalesce(in_both, 0) AS in_both, coalesce(current_only, 0) AS current_only, coalesce(proposed_only, 0) AS proposed_only FROM l FULL JOIN r ON l.entity_id = r.entity_id""")
def ab_diff_by_size(spark, sf):
    return diff.ab_diff(_side(spark, sf, 320), _side(spark, sf, 640))


@query(f"""{_SIZES} h AS (SELECT DISTINCT a.id FROM a JOIN b ON a.entity_id = b.entity_id AND a.class_id = b.class_id AND a.sample_index BETWEEN b.sample_index - 5 AND b.sample_index + 5 AND a.t - 0.2 < b.t + 0.2 AND b.t - 0.2 < a.t + 0.2
 AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h) SELECT class_id, count(*) AS n FROM a WHERE id IN (SELECT id FROM h) GROUP BY 1""")
def nearby_boxes_by_size(spark, sf):
    return review.nearby(_side(spark, sf, 320), _side(spark, sf, 640)).groupBy("class_id").agg(F.count("*").alias("n"))


@query(""", m AS (SELECT entity_id, unnest(range(floor(max(t))::BIGINT + 1)) AS i FROM det GROUP BY 1), h AS (SELECT m.entity_id, m.i, count(*) AS live FROM m JOIN det a ON a.entity_id = m.entity_id
 AND a.sample_index BETWEEN m.i * 10 - 5 AND m.i * 10 + 5 AND a.t - 0.2 <= m.i AND m.i <= a.t + 0.2 GROUP BY 1, 2) SELECT entity_id, sum(live)::BIGINT AS total, max(live) AS most FROM h GROUP BY 1""")
def live_history_all(spark, sf):
    last = detections(spark, sf).groupBy("entity_id").agg(F.floor(F.max("t")).alias("last"))
    grid = last.select("entity_id", F.explode(F.expr("sequence(0L, last)")).alias("i")).select("entity_id", F.col("i").cast("double").alias("t"))
    return review.live_history(grid, _side(spark, sf), ["entity_id"]).groupBy("entity_id").agg(F.sum("live").alias("total"), F.max("live").alias("most"))


@query("SELECT CASE WHEN t > 60 THEN 'pending' WHEN t + 30 > 60 THEN 'live' ELSE 'past' END AS state, count(*) AS n FROM det GROUP BY 1")
def live_states(spark, sf):
    return detections(spark, sf).groupBy(review.live_state(F.col("t"), F.col("t") + 30, 60.0).alias("state")).agg(F.count("*").alias("n"))


@query(""", w AS (SELECT entity_id, label, count(*) AS n FROM ev GROUP BY 1, 2) SELECT entity_id, count(*) AS tracks, sum(n)::BIGINT AS samples FROM w WHERE n > 1 GROUP BY 1""", "ev")
def motion_index(spark, sf):
    out = review.motion_index(timeline(spark, sf), ["entity_id", "label"])
    return out.groupBy("entity_id").agg(F.count_if(F.col("place") == 1).alias("tracks"), F.count("*").alias("samples"))


@query(""", i AS (SELECT entity_id, label, t AS s, t + 1000 AS e FROM ev), m AS (SELECT *, max(e) OVER (PARTITION BY entity_id, label ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM i)
 SELECT entity_id, label, count(*) FILTER (p IS NULL OR s - p >= 50000) AS merged FROM m GROUP BY 1, 2""", "ev")
def gap_joined_events(spark, sf):
    spans = timeline(spark, sf).select("entity_id", "label", F.col("t").alias("start"), (F.col("t") + 1000).alias("stop"))
    return intervals.islands(spans, ["entity_id", "label"], gap=50000.0, strict=True).groupBy("entity_id", "label").agg(F.count("*").alias("merged"))


@query(f""", s AS (SELECT class_id, count(*) AS n, list_sort(list(w * h / {FRAME}::DOUBLE)) AS a, list_sort(list(w / h) FILTER (h <> 0)) AS r FROM det GROUP BY 1)
 SELECT class_id, n, round_even(a[round_even(0.01 * (len(a) - 1), 0)::INT + 1] / 1.1, 6) AS area_lo, round_even(least(1.0, a[round_even(0.99 * (len(a) - 1), 0)::INT + 1] * 1.1), 6) AS area_hi,
 round_even(r[round_even(0.01 * (len(r) - 1), 0)::INT + 1] / 1.1, 3) AS aspect_lo, round_even(r[round_even(0.99 * (len(r) - 1), 0)::INT + 1] * 1.1, 3) AS aspect_hi FROM s""")
def geometry_bounds(spark, sf):
    return review.geometry_bounds(detections(spark, sf), FRAME)


@query("""SELECT class_id, n, s AS start_at, round_even(greatest(0.125, 0.12 + (s - 0.12) / 2), 3)::DOUBLE AS continue_at FROM (SELECT class_id, len(v) AS n, round_even(greatest(0.13, v[round_even(0.25 * (len(v) - 1), 0)::INT + 1]), 3)::DOUBLE AS s FROM (SELECT class_id, list_sort(list(score)) AS v FROM det GROUP BY 1))""")
def hysteresis_suggestion(spark, sf):
    return review.hysteresis(detections(spark, sf), 0.12)


@query("""SELECT CASE WHEN u < 1 THEN 'bar' WHEN u < 4 THEN 'blur' ELSE 'sticker' END AS style, count(*) AS n FROM (SELECT ('0x' || left(md5(o_orderkey::VARCHAR), 8))::BIGINT / 4294967296.0::DOUBLE * 5 AS u FROM orders) GROUP BY 1""", "")
def style_draw(spark, sf):
    style = review.style_draw(F.col("o_orderkey").cast("string"), [("bar", 1.0), ("blur", 3.0), ("sticker", 1.0)])
    return table(spark, sf, "orders").groupBy(style.alias("style")).agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r <= 5", "")
def subset_of_each(spark, sf):
    return catalog.first_of_folder(table(spark, sf, "orders"), "o_orderpriority", ["o_orderdate", "o_orderkey"], 5).select("o_orderpriority", "o_orderkey")


@query("""SELECT o_custkey, round(p / w, 6) AS share FROM (SELECT o_custkey, sum((o_orderstatus = 'F')::INT)::DOUBLE AS p, count(*)::DOUBLE AS w FROM orders GROUP BY 1) WHERE w >= 5 AND p > 0 ORDER BY p / w DESC, o_custkey LIMIT 10""", "")
def top_by_share(spark, sf):
    failed = (F.col("o_orderstatus") == "F").cast("int")
    return review.top_by_share(table(spark, sf, "orders"), "o_custkey", failed.cast("double"), F.lit(1.0), 5.0, 10).withColumn("share", r6("share"))


@query("""WITH o AS (SELECT row_number() OVER () AS r, o_custkey, o_orderstatus, epoch(o_orderdate)::BIGINT AS tm FROM orders), f AS (SELECT f.r, f.o_custkey, f.tm, min(s.tm) AS again FROM o f LEFT JOIN o s ON s.o_custkey = f.o_custkey AND s.o_orderstatus <> 'F' AND s.tm > f.tm WHERE f.o_orderstatus = 'F' GROUP BY 1, 2, 3)
 SELECT o_custkey, count(*) AS failures, count(again) AS recovered, coalesce(sum(again - tm), 0)::BIGINT AS waited FROM f GROUP BY 1""", "")
def later_success(spark, sf):
    o = table(spark, sf, "orders").withColumn("at", F.unix_seconds(F.col("o_orderdate").cast("timestamp")))
    found = runs.later_success(o, ["o_custkey"], "at", F.col("o_orderstatus") == "F")
    return found.groupBy("o_custkey").agg(F.count("*").alias("failures"), F.count("recovered_at").alias("recovered"), F.coalesce(F.sum(F.col("recovered_at") - F.col("at")), F.lit(0)).alias("waited"))


@query("""SELECT e.k AS entity_id, r.i::INT AS i, CASE WHEN r.i = 0 THEN 0 ELSE floor(r.i / 10.0::DOUBLE * 29.97::DOUBLE) END::BIGINT AS frame FROM (SELECT n_nationkey AS k FROM nation) e JOIN range(60) r(i) ON r.i < 20 + e.k""", "")
def sample_grid(spark, sf):
    e = table(spark, sf, "nation").select(F.col("n_nationkey").alias("entity_id"), (F.col("n_nationkey") + 20).alias("n"), F.lit(10.0).alias("fps"), F.lit(29.97).alias("native_fps"))
    return sample_times(e).select("entity_id", "i", "frame")


@query("""SELECT class_id, size, CASE WHEN class_id = 'label_a' AND size = 320 THEN 0.5 WHEN class_id = 'label_a' THEN 0.4 WHEN size = 640 THEN 0.3 ELSE 0.35 END::DOUBLE AS setting, count(*) AS n FROM det GROUP BY 1, 2, 3""")
def settings_resolution(spark, sf):
    d = detections(spark, sf).withColumn("variant", F.concat_ws("/", "class_id", F.col("size").cast("string"))).withColumn("backend", F.col("size").cast("string"))
    setting = F.coalesce(review.resolved(d, "variant", [{"label_a/320": 0.5}], None), review.resolved(d, "class_id", [{"label_a": 0.4}], None), review.resolved(d, "backend", [{"640": 0.3}], 0.35))
    return d.groupBy("class_id", "size", setting.alias("setting")).agg(F.count("*").alias("n"))


@query(""", w AS (SELECT entity_id, label, lag(label) OVER (PARTITION BY entity_id ORDER BY t) AS p FROM ev) SELECT entity_id, count(*) FILTER (p IS NULL OR p <> label) AS changes FROM w GROUP BY 1""", "ev")
def stream_changes(spark, sf):
    out = live.available_now(live.changed(live.event_stream(spark, sf), "entity_id", "at", "label"))
    return out.groupBy("entity_id").agg(F.count("*").alias("changes"))


@query("""SELECT user_id AS entity_id, epoch(time_bucket(INTERVAL 1 DAY, ts))::BIGINT AS window_start, count(*) AS n FROM events WHERE time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1, 2""", "")
def stream_windows(spark, sf):
    out = live.available_now(live.windowed(live.event_stream(spark, sf), ["entity_id"], "at", "1 day", "1 hour"))
    return out.select("entity_id", F.unix_seconds("window_start").alias("window_start"), "n")


_ALIVE = """l AS (SELECT {g}, loser AS k, list(winner) AS ws FROM e GROUP BY ALL),
 s AS (SELECT {og}, o.k, coalesce(l.ws, []) AS ws FROM o LEFT JOIN l ON {on} AND o.k = l.k),
 r AS (SELECT {g}, k, [k] AS alive FROM s WHERE k = 1 UNION ALL SELECT {sg}, s.k, CASE WHEN len(list_intersect(s.ws, r.alive)) > 0 THEN r.alive ELSE list_append(r.alive, s.k) END FROM r JOIN s ON {rs} AND s.k = r.k + 1),
 f AS (SELECT {g}, arg_max(len(alive), k) AS kept FROM r GROUP BY {g})""".format(g="entity_id, sample_index, class_id", og="o.entity_id, o.sample_index, o.class_id", sg="s.entity_id, s.sample_index, s.class_id", on="o.entity_id = l.entity_id AND o.sample_index = l.sample_index AND o.class_id = l.class_id", rs="s.entity_id = r.entity_id AND s.sample_index = r.sample_index AND s.class_id = r.class_id")


@query(f""", RECURSIVE_ o AS (SELECT *, row_number() OVER (PARTITION BY entity_id, sample_index, class_id ORDER BY score DESC, pos) AS k FROM det),
 e AS (SELECT a.entity_id, a.sample_index, a.class_id, a.k AS loser, b.k AS winner FROM o a JOIN o b ON {_SAME} AND a.class_id = b.class_id AND a.k > b.k AND {_IOU} > 0.4),
 {_ALIVE} SELECT entity_id, class_id, sum(kept)::BIGINT AS kept FROM f GROUP BY 1, 2""")
def nms(spark, sf):
    return tensor.nms(detections(spark, sf), ["entity_id", "sample_index", "class_id"], 0.4).groupBy("entity_id", "class_id").agg(F.count("*").alias("kept"))


from . import derived  # noqa: E402, F401
