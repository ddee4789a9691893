"""More registered queries: replay metrics and decisions, rule suggestions, catalog, profiles, people, windows. SQL is stated from the rules, not from the Spark code."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as B
from ..operators import catalog, decide, diff, people, review, runs, stages, stats, structure, tensor, tracking
from ..sources.detections import detections, table, timeline
from ..streaming import live
from .registry import _IOU, _IX, _IY, _SAME, _SIZES, FRAME, RULES, _side, query, r6

LABELS = ["label_a", "label_b", "label_c"]


# --- tracking, replay and review --------------------------------------------------------------------------------------------

_GAPS = """, a AS (SELECT *, CASE WHEN t - lag(t) OVER o <= 30000 THEN 0 ELSE 1 END AS new FROM ev WINDOW o AS (PARTITION BY entity_id ORDER BY t)), b AS (SELECT *, sum(new) OVER (PARTITION BY entity_id ORDER BY t) AS k FROM a),
 c AS (SELECT entity_id, k, count(*) AS n FROM b GROUP BY 1, 2)"""


def _walk(spark, sf):
    """One box an instant and user, its place and size from value, within reach of the one before."""
    v = F.col("value")
    ev = timeline(spark, sf)
    return ev.select("entity_id", F.lit("one").alias("class_id"), "t", F.col("t").alias("start"), F.col("t").alias("stop"), v.alias("x"), (v * 2).alias("y"), (v + 20).alias("w"), F.lit(30.0).alias("h"), F.lit(0.9).alias("score"), F.lit(0).alias("pos"), F.lit(False).alias("provisional"))


@query(_GAPS + """ SELECT entity_id, sum(n - 1)::BIGINT AS matches, count(*) AS new_tracks, 0::BIGINT AS contention, 0::BIGINT AS risky, coalesce(sum(n) FILTER (n >= 2), 0)::BIGINT AS rendered, 0::BIGINT AS interpolated, 0::BIGINT AS dropped_provisional, count(*) FILTER (n = 1) AS dropped_unconfirmed FROM c GROUP BY 1""", "ev")
def track_decisions(spark, sf):
    found = tracking.tracking(_walk(spark, sf), tracking.Settings(max_gap=30000.0, reach=1e6, min_hits=2, interpolate=0.0))
    return tracking.decisions(found, ["entity_id"])


@query(_GAPS + """ SELECT 'one' AS class_id, 'no-nearby-track' AS reason, count(*) AS n, 0::BIGINT AS near_misses FROM c""", "ev")
def track_resets(spark, sf):
    return tracking.resets(tracking.tracking(_walk(spark, sf), tracking.Settings(max_gap=30000.0, reach=1e6)))


@query()
def track_styles(spark, sf):
    det = stages.entry_gate(detections(spark, sf), [(n, 0.3, 0.2) for n in LABELS], 0.3)
    looks = (tracking.Style("bar", 1.0, 0.5, 0.5), tracking.Style("blur", 2.0, -0.2), tracking.Style("pixel", 1.0))
    found = tracking.tracking(det, tracking.Settings(max_gap=0.6, wide=500, high=460, x_safety=0.1, y_safety=0.1, styles=looks, dwell=1.0, paired=True))
    return decide.style_variety(found)


@query(f""", r AS (SELECT * FROM det WHERE size = 640), k AS (SELECT * FROM (VALUES ('label_a'), ('label_b')) x(class_id)),
 c AS (SELECT class_id, count(*) AS rendered, sum(w * h / {FRAME} * greatest((t + 0.2) - (t - 0.2), 0)) AS coverage FROM r GROUP BY 1), s AS (SELECT * FROM det WHERE score >= 0.5),
 u AS (SELECT class_id, count(*) AS uncovered FROM s WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.entity_id = s.entity_id AND r.class_id = s.class_id AND r.sample_index BETWEEN s.sample_index - 3 AND s.sample_index + 3
 AND s.t >= r.t - 0.2 AND s.t <= r.t + 0.2 AND s.x + s.w / 2 BETWEEN r.x AND r.x + r.w AND s.y + s.h / 2 BETWEEN r.y AND r.y + r.h) GROUP BY 1)
 SELECT class_id, coalesce(rendered, 0) AS rendered, round(coalesce(coverage, 0), 4) AS coverage, (SELECT count(*) FROM s WHERE s.class_id = k.class_id) AS confident, coalesce(uncovered, 0) AS uncovered FROM k LEFT JOIN c USING (class_id) LEFT JOIN u USING (class_id)""")
def replay_metrics(spark, sf):
    out = decide.replay_metrics(_side(spark, sf, 640), detections(spark, sf), FRAME, ["label_a", "label_b"])
    return out.withColumn("coverage", F.round("coverage", 4))


@query(""", c AS (SELECT entity_id, class_id, sum(w * h) FILTER (score > 0.3) AS before, coalesce(sum(w * h) FILTER (score > 0.5), 0) AS after FROM det GROUP BY 1, 2) SELECT entity_id, round(greatest(0, -min((after - before) / before)), 6) AS worst_loss FROM c WHERE before > 0 GROUP BY 1""")
def worst_coverage_loss(spark, sf):
    d = detections(spark, sf)
    cover = lambda least: d.where(F.col("score") > least).groupBy("entity_id", "class_id").agg(F.sum(B.area()).alias("coverage"))
    return decide.worst_loss(cover(0.3), cover(0.5), ["entity_id"]).withColumn("worst_loss", r6("worst_loss"))


@query("""SELECT class_id, count(*) AS n FROM det d WHERE size = 640 AND NOT EXISTS (SELECT 1 FROM det b WHERE b.size = 320 AND b.entity_id = d.entity_id AND b.class_id = d.class_id AND b.sample_index BETWEEN d.sample_index - 3 AND d.sample_index + 3
 AND d.t >= b.t - 0.2 AND d.t <= b.t + 0.2 AND d.x + d.w / 2 BETWEEN b.x AND b.x + b.w AND d.y + d.h / 2 BETWEEN b.y AND b.y + b.h) GROUP BY 1""")
def uncovered_by_size(spark, sf):
    boxes = _side(spark, sf, 320).drop("id").withColumnsRenamed({c: f"b{c}" for c in "xywh"})
    return diff.uncovered(detections(spark, sf).where("size = 640"), boxes).groupBy("class_id").agg(F.count("*").alias("n"))


_SUPPRESSED = f"""p AS (SELECT a.entity_id, a.sample_index, a.pos, min(b.pos * 10 + CASE a.class_id WHEN 'label_a' THEN 0 ELSE 1 END) AS who FROM det a JOIN det b ON {_SAME} AND a.pos <> b.pos
 AND ((a.class_id = 'label_a' AND b.class_id = 'label_b' AND {_IOU} >= 0.3 AND b.score - a.score >= 0.1) OR (a.class_id = 'label_c' AND b.class_id = 'label_b' AND {_IOU} >= 0.4 AND b.score - a.score >= 0.2)) GROUP BY 1, 2, 3),
 sup AS (SELECT det.*, who // 10 AS by_pos, who % 10 AS rule FROM det JOIN p USING (entity_id, sample_index, pos))"""


@query(f""", a AS (SELECT sample_index * 16000 + entity_id * 1000 + pos AS id, * FROM det), {_SUPPRESSED},
 h AS (SELECT a.id, d.rule, count(*) AS n FROM a JOIN sup d ON a.entity_id = d.entity_id AND a.class_id = d.class_id AND d.sample_index BETWEEN a.sample_index - 3 AND a.sample_index + 3 AND d.t >= a.t - 0.2 AND d.t <= a.t + 0.2
 AND d.x + d.w / 2 BETWEEN a.x AND a.x + a.w AND d.y + d.h / 2 BETWEEN a.y AND a.y + a.h GROUP BY 1, 2), q AS (SELECT id, rule, row_number() OVER (PARTITION BY id ORDER BY n DESC, rule) AS r FROM h)
 SELECT a.class_id, coalesce(q.rule::VARCHAR, 'tracking') AS cause, round_even(sum(greatest((a.t + 0.2) - (a.t - 0.2), 0)), 1)::DOUBLE AS seconds FROM a LEFT JOIN q ON a.id = q.id AND q.r = 1 GROUP BY 1, 2""")
def cause_attribution(spark, sf):
    dropped = stages.suppressed(detections(spark, sf), RULES).where("by_pos is not null").withColumn("rule", F.col("rule").cast("string"))
    return review.cause_seconds(review.causes(_side(spark, sf), dropped), ["class_id"])


@query(f""", {_SUPPRESSED} SELECT 'now' AS rule_set, sup.class_id || '<-' || b.class_id AS rule, count(*) AS removed, count(*) FILTER (sup.score > 0.25) AS renderable,
 count(*) FILTER (sup.score > 0.25 AND {_IOU.replace('a.', 'sup.')} < 0.2) AS side_by_side FROM sup JOIN det b ON sup.entity_id = b.entity_id AND sup.sample_index = b.sample_index AND sup.by_pos = b.pos GROUP BY 1, 2
 UNION ALL SELECT 'strict', 'label_a<-label_b', count(*), count(*) FILTER (score > 0.25), count(*) FILTER (score > 0.25 AND i < 0.2) FROM (SELECT a.score, arg_min({_IOU}, b.pos) AS i FROM det a JOIN det b ON {_SAME} AND a.pos <> b.pos AND a.class_id = 'label_a' AND b.class_id = 'label_b' AND {_IOU} >= 0.1 AND b.score - a.score >= 0.3 GROUP BY a.entity_id, a.sample_index, a.pos, a.score)""")
def suppression_impact(spark, sf):
    return decide.suppression_impact(detections(spark, sf), {"now": RULES, "strict": [("label_a", "label_b", 0.1, 0.3)], "none": []}, dict.fromkeys(LABELS, 0.25))


_PAIRS = f""", pr AS (SELECT a.class_id AS label, b.class_id AS suppressor, {_IOU} AS iou, b.score - a.score AS margin FROM det a JOIN det b ON {_SAME} AND a.class_id <> b.class_id WHERE {_IOU} > 0),
 hb AS (SELECT label, suppressor, least(19, floor(iou / 0.05))::INT AS b, count(*) AS n FROM pr GROUP BY 1, 2, 3), hk AS (SELECT DISTINCT label, suppressor FROM pr),
 hh AS (SELECT hk.label, hk.suppressor, list(coalesce(n, 0) ORDER BY x.b) AS h FROM hk CROSS JOIN range(20) x(b) LEFT JOIN hb ON hb.label = hk.label AND hb.suppressor = hk.suppressor AND hb.b = x.b GROUP BY 1, 2),
 hp AS (SELECT *, list_position(h[1:6], list_max(h[1:6])) AS lo, 10 + list_position(h[11:20], list_max(h[11:20])) AS hi FROM hh), hm AS (SELECT *, CASE WHEN hi - lo > 1 THEN h[lo + 1:hi - 1] ELSE [] END AS mid FROM hp),
 va AS (SELECT label, suppressor, CASE WHEN list_sum(h[11:20]) >= greatest(30, 0.03 * list_sum(h)) AND len(mid) > 0 AND list_min(mid) * 2 <= least(list_max(h[1:6]), list_max(h[11:20])) THEN round_even((lo + len(mid) - list_position(list_reverse(mid), list_min(mid)) + 0.5) * 0.05, 3)::DOUBLE END AS valley FROM hm),
 su AS (SELECT label, suppressor, count(*) AS n, round(avg((margin > 0)::INT), 6) AS win_rate, any_value(valley) AS min_iou, CASE WHEN any_value(valley) IS NOT NULL THEN coalesce(round_even(median(margin) FILTER (iou >= valley AND margin > 0), 3), 0)::DOUBLE END AS margin,
 CASE WHEN any_value(valley) IS NOT NULL THEN count(*) FILTER (iou >= valley) END AS same_spot, CASE WHEN any_value(valley) IS NOT NULL THEN round((count(*) FILTER (iou >= valley AND margin > 0)) / (count(*) FILTER (iou >= valley)), 6) END AS same_spot_wins FROM pr JOIN va USING (label, suppressor) GROUP BY 1, 2 HAVING count(*) >= 30)"""


def _suggested(spark, sf):
    return decide.suggested_rules(decide.overlapping_pairs(detections(spark, sf))).withColumns({c: r6(c) for c in ("win_rate", "same_spot_wins")})


@query(_PAIRS + " SELECT * FROM su")
def suggested_rules(spark, sf):
    return _suggested(spark, sf)


@query(_PAIRS + " SELECT label, suppressor, CASE WHEN c.label IS NOT NULL THEN 'configured' WHEN f.label IS NOT NULL THEN 'refused' WHEN su.min_iou IS NULL THEN 'none' WHEN su.same_spot_wins < 0.2 THEN 'rarely wins' ELSE 'added' END AS what FROM su LEFT JOIN (VALUES ('label_a', 'label_b')) c(label, suppressor) USING (label, suppressor) LEFT JOIN (VALUES ('label_b', 'label_c')) f(label, suppressor) USING (label, suppressor)")
def rule_additions(spark, sf):
    every = _suggested(spark, sf)
    added = decide.additions(every, [("label_a", "label_b")], [("label_b", "label_c")]).select("label", "suppressor", F.lit(True).alias("_a"))
    what = F.when(F.col("_a"), "added").when((F.col("label") == "label_a") & (F.col("suppressor") == "label_b"), "configured").when((F.col("label") == "label_b") & (F.col("suppressor") == "label_c"), "refused").when(F.col("min_iou").isNull(), "none").otherwise("rarely wins")
    return every.join(added, ["label", "suppressor"], "left").select("label", "suppressor", what.alias("what"))


@query(_PAIRS + " SELECT coalesce(c.label, su.label) AS label, coalesce(c.suppressor, su.suppressor) AS suppressor, CASE WHEN su.label IS NULL THEN 'dropped' WHEN c.label IS NULL THEN 'added' WHEN c.min_iou IS NOT DISTINCT FROM su.min_iou AND c.margin IS NOT DISTINCT FROM su.margin THEN 'unchanged' ELSE 'retuned' END AS change FROM su FULL JOIN (VALUES ('label_a', 'label_b', 0.3::DOUBLE, 0.1::DOUBLE), ('label_x', 'label_b', 0.3, 0.1)) c(label, suppressor, min_iou, margin) ON c.label = su.label AND c.suppressor = su.suppressor")
def rule_changes(spark, sf):
    now = spark.createDataFrame([("label_a", "label_b", 0.3, 0.1), ("label_x", "label_b", 0.3, 0.1)], "label string, suppressor string, min_iou double, margin double")
    return decide.rule_changes(now, _suggested(spark, sf))


@query(f""", c AS (SELECT * FROM (VALUES ('max', 0.10), ('max', 0.25), ('min', 0.03)) x(kind, bound)), v AS (SELECT class_id, w * h / {FRAME} AS v FROM det),
 b AS (SELECT class_id, kind, bound, list_sort(list(v / bound)) AS r, list_sort(list(sqrt(bound / v))) AS s FROM v JOIN c ON (kind = 'max' AND v > bound) OR (kind = 'min' AND v < bound) GROUP BY 1, 2, 3), n AS (SELECT class_id, count(*) AS n FROM v GROUP BY 1)
 SELECT n.class_id, c.kind, c.bound::DOUBLE AS bound, n.n, coalesce(len(r), 0) AS violates, round(coalesce(len(r), 0) / n.n, 6) AS share, round(r[1], 6) AS least_over, round(r[round_even(0.5 * (len(r) - 1), 0)::INT + 1], 6) AS median_over, round(r[len(r)], 6) AS most_over,
 CASE WHEN c.kind = 'max' THEN round(s[round_even(0.5 * (len(s) - 1), 0)::INT + 1], 6) END AS median_shrink FROM n CROSS JOIN c LEFT JOIN b ON b.class_id = n.class_id AND b.kind = c.kind AND b.bound = c.bound""")
def bound_what_if(spark, sf):
    d = detections(spark, sf).withColumn("v", F.col("w") * F.col("h") / FRAME)
    out = review.bound_what_if(d, "v", [("max", 0.10), ("max", 0.25), ("min", 0.03)])
    return out.withColumns({c: r6(c) for c in ("share", "least_over", "median_over", "most_over", "median_shrink")})


# A candidate is a line number, a configuration a return flag; the baseline is line 4.
_ROWS = """WITH m AS (SELECT l_returnflag AS configuration, l_linenumber AS value, count(*) FILTER (l_quantity > 25) AS new_tracks, count(*) FILTER (l_discount > 0.05) AS risky, avg(l_tax) / 10 - 0.001 AS coverage_loss, count(*) FILTER (l_quantity < 3) AS missed, count(*) AS total FROM lineitem GROUP BY 1, 2),
 b AS (SELECT * FROM m WHERE value = 4), s AS (SELECT m.configuration, m.value, b.new_tracks - m.new_tracks AS resets_avoided, m.risky - b.risky AS risky_added, m.coverage_loss, m.missed, m.total FROM m JOIN b USING (configuration) WHERE m.value <> 4),
 p AS (SELECT *, CASE WHEN resets_avoided > 0 THEN risky_added / resets_avoided END AS price FROM s), v AS (SELECT *, CASE WHEN coverage_loss > 0.005 THEN 'coverage' WHEN resets_avoided <= 0 THEN 'no_gain' WHEN price > 5 THEN 'price' ELSE 'eligible' END AS verdict FROM p)"""


def _candidates(spark, sf):
    q = lambda c: F.count_if(F.expr(c))
    m = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("configuration"), F.col("l_linenumber").alias("value")).agg(q("l_quantity > 25").alias("new_tracks"), q("l_discount > 0.05").alias("risky"), (F.avg("l_tax") / 10 - 0.001).alias("coverage_loss"), q("l_quantity < 3").alias("missed"), F.count("*").alias("total"))
    return m.withColumn("is_baseline", F.col("value") == 4)


@query(_ROWS + " SELECT configuration, value, resets_avoided, risky_added, round(price, 6) AS price, verdict FROM v", "")
def loosening_prices(spark, sf):
    return decide.priced(_candidates(spark, sf), ["configuration"]).select("configuration", "value", "resets_avoided", "risky_added", r6("price").alias("price"), "verdict")


@query(_ROWS + """, e AS (SELECT value, sum(resets_avoided) AS a FROM v GROUP BY 1 HAVING count(DISTINCT configuration) FILTER (verdict = 'eligible') = (SELECT count(DISTINCT configuration) FROM v))
 SELECT 'all' AS k, (SELECT value FROM e ORDER BY a DESC, value LIMIT 1) AS value, (SELECT max(a) FROM e)::BIGINT AS resets_avoided""", "")
def loosening_choice(spark, sf):
    scored = decide.priced(_candidates(spark, sf), ["configuration"]).withColumn("k", F.lit("all"))
    return decide.chosen_value(scored, ["k"], "configuration")


@query(_ROWS + """, w AS (SELECT configuration, arg_min(value, -resets_avoided * 100 + value) AS value FROM v WHERE verdict = 'eligible' GROUP BY 1), n AS (SELECT count(*) AS c, count(DISTINCT value) AS d FROM w)
 SELECT 'all' AS k, (SELECT count(*) FROM w, n WHERE c >= 2 AND d >= 2) AS configurations, (SELECT coalesce(sum(value), 0) FROM w, n WHERE c >= 2 AND d >= 2)::BIGINT AS values""", "")
def split_values(spark, sf):
    scored = decide.priced(_candidates(spark, sf), ["configuration"]).withColumn("k", F.lit("all"))
    return decide.split_values(scored, ["k"], "configuration").agg(F.lit("all").alias("k"), F.count("*").alias("configurations"), F.coalesce(F.sum("value"), F.lit(0)).cast("long").alias("values"))


@query(_ROWS + """, g AS (SELECT value, sum(missed) AS missed, sum(total) AS total, max(coverage_loss) AS loss FROM m GROUP BY 1), f AS (SELECT count(DISTINCT missed) AS kinds, min(missed) FILTER (loss <= 0.005) AS floor, max(total) AS total, max(missed) FILTER (value = 4) AS held FROM g)
 SELECT 'all' AS k, 4 AS baseline, CASE WHEN (SELECT kinds FROM f) > 1 THEN coalesce((SELECT max(value) FROM g, f WHERE loss <= 0.005 AND missed <= floor + 0.001 * f.total AND NOT (value > 4 AND missed > held * 1.25)), 4) ELSE 4 END AS value""", "")
def strictest_value(spark, sf):
    return decide.strictest(_candidates(spark, sf).withColumn("k", F.lit("all")), ["k"])


@query(_ROWS + """, o AS (SELECT *, row_number() OVER (PARTITION BY configuration ORDER BY risky_added, value) AS r FROM v WHERE value < 4 AND coverage_loss <= 0.005 AND risky_added < 0 AND -risky_added >= -resets_avoided)
 SELECT configuration, value, -risky_added AS risky_removed, -resets_avoided AS resets_added FROM o WHERE r = 1 UNION ALL SELECT 'none', 0, 0, 0""", "")
def tightening_review(spark, sf):
    scored = decide.priced(_candidates(spark, sf), ["configuration"]).withColumn("baseline", F.lit(4))
    out = decide.tighter_to_review(scored, ["configuration"], 0.005)
    return out.unionByName(spark.createDataFrame([("none", 0, 0, 0)], "configuration string, value int, risky_removed long, resets_added long"))


_VARIANTS = """WITH c AS (SELECT o_orderstatus, o_orderpriority AS variant, count(*) FILTER (o_totalprice > 200000) - 10 AS restored, count(*) FILTER (o_totalprice < 100000) - 5 AS risky_added FROM orders GROUP BY 1, 2),
 v AS (SELECT *, CASE WHEN restored > 0 THEN greatest(risky_added, 0) / restored END AS price FROM c), h AS (SELECT *, coalesce(restored > 0 AND price <= 2, false) AS helps FROM v)"""


def _variants(spark, sf):
    q = lambda c: F.count_if(F.expr(c))
    c = table(spark, sf, "orders").groupBy("o_orderstatus", F.col("o_orderpriority").alias("variant")).agg((q("o_totalprice > 200000") - 10).alias("restored"), (q("o_totalprice < 100000") - 5).alias("risky_added"))
    return decide.burst_verdict(c, 2.0)


@query(_VARIANTS + " SELECT o_orderstatus, variant, restored, risky_added, round(price, 6) AS price, helps FROM h", "")
def burst_verdicts(spark, sf):
    return _variants(spark, sf).withColumn("price", r6("price"))


@query(_VARIANTS + ", o AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY restored DESC, risky_added, variant) AS r FROM h WHERE helps) SELECT s.o_orderstatus, o.variant FROM (SELECT DISTINCT o_orderstatus FROM orders) s LEFT JOIN o ON o.o_orderstatus = s.o_orderstatus AND r = 1", "")
def best_variant(spark, sf):
    v = _variants(spark, sf)
    return v.select("o_orderstatus").distinct().join(decide.best_variant(v, ["o_orderstatus"]), "o_orderstatus", "left")


@query("""WITH t AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS c, count(*) FILTER (o_orderstatus = 'O') AS p FROM orders GROUP BY 1) SELECT o_custkey, CASE WHEN p > c THEN 'proposed' WHEN c > 0 THEN 'current' ELSE 'current (no verdict yet)' END AS winner FROM t""", "")
def verdict_winners(spark, sf):
    t = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("current"), F.count_if(F.col("o_orderstatus") == "O").alias("proposed"))
    return decide.winners(t, ["o_custkey"])


@query(f"""{_SIZES} x AS (SELECT 1), n AS (SELECT entity_id, sample_index, class_id, count(*) FILTER (size = 320) AS a, count(*) FILTER (size = 640) AS b FROM det GROUP BY 1, 2, 3)
 SELECT entity_id, sum(least(a, b))::BIGINT AS matched, sum(greatest(a - b, 0))::BIGINT AS unmatched_current, sum(greatest(b - a, 0))::BIGINT AS unmatched_other FROM n GROUP BY 1""")
def run_diff(spark, sf):
    d = detections(spark, sf)
    pairs = diff.paired(d.where("size = 320"), d.where("size = 640"), 0.01, 2.0)
    return diff.run_summary(pairs, ["entity_id"]).select("entity_id", "matched", "unmatched_current", "unmatched_other")


@query()
def run_diff_outcomes(spark, sf):
    d = detections(spark, sf)
    return diff.run_summary(diff.paired(d.where("size = 320"), d.where("size = 640"), 0.05, 40.0), ["class_id"])


# --- statistics, structure, profiles ----------------------------------------------------------------------------------------


@query(""", s AS (SELECT entity_id, sample_index, count(DISTINCT class_id) AS n FROM det WHERE score >= 0.5 GROUP BY 1, 2) SELECT entity_id, round_even(count(*) FILTER (n >= 2) / 10.0, 1)::DOUBLE AS mixed FROM s GROUP BY 1""")
def mixed_seconds(spark, sf):
    return stats.mixed_seconds(detections(spark, sf), 10.0)


@query(""", d AS (SELECT * FROM det WHERE score >= 0.5 AND class_id IN ('label_a', 'label_b')), s AS (SELECT entity_id, class_id, round_even(count(DISTINCT sample_index) / 10.0, 1)::DOUBLE AS v FROM d GROUP BY 1, 2),
 x AS (SELECT entity_id, round_even((count(*) FILTER (n >= 2)) / 10.0, 1)::DOUBLE AS m FROM (SELECT entity_id, sample_index, count(DISTINCT class_id) AS n FROM d GROUP BY 1, 2) GROUP BY 1), t AS (SELECT entity_id, max(t) AS duration FROM det GROUP BY 1),
 l AS (SELECT entity_id, max(floor(round_even(t * 10, 0) / 100))::BIGINT + 1 AS n FROM d GROUP BY 1)
 SELECT t.entity_id, round(duration, 3) AS duration, coalesce((SELECT v FROM s WHERE s.entity_id = t.entity_id AND class_id = 'label_a'), 0) AS a, coalesce((SELECT v FROM s WHERE s.entity_id = t.entity_id AND class_id = 'label_b'), 0) AS b, coalesce(m, 0) AS mixed, coalesce(l.n, 0) AS buckets FROM t LEFT JOIN x USING (entity_id) LEFT JOIN l USING (entity_id) WHERE duration > 0""")
def content_signatures(spark, sf):
    d = detections(spark, sf)
    s = stats.content_signature(d, d.groupBy("entity_id").agg(F.max("t").alias("duration")), 10.0, ["label_a", "label_b"])
    return s.select("entity_id", F.round("duration", 3).alias("duration"), F.col("seconds")["label_a"].alias("a"), F.col("seconds")["label_b"].alias("b"), "mixed", F.size("timeline").cast("long").alias("buckets"))


@query()
def same_footage(spark, sf):
    d = timeline(spark, sf).select("entity_id", (F.col("t") / 3600).alias("t"), F.col("label").alias("class_id"), F.lit(1.0).alias("score"))
    s = stats.content_signature(d, d.groupBy("entity_id").agg(F.max("t").alias("duration")), 1.0, ["click", "view", "purchase"])
    return stats.footage_copies(s)


@query(f""", n AS (SELECT entity_id, sample_index, count(*) AS n FROM det GROUP BY 1, 2), q AS (SELECT entity_id, list_sort(list(n)) AS v FROM n GROUP BY 1)
 SELECT entity_id, (SELECT count(*) FROM det d WHERE d.entity_id = q.entity_id) AS detections, (SELECT round_even(avg((x + w / 2 < 250)::INT), 3)::DOUBLE FROM det d WHERE d.entity_id = q.entity_id) AS left_half_fraction, len(v) AS frames_with_boxes,
 (v[(len(v) - 1) // 2 + 1] + v[len(v) // 2 + 1]) / 2.0::DOUBLE AS median_simultaneous, v[floor((len(v) - 1) * 0.9)::INT + 1]::BIGINT AS p90_simultaneous, (SELECT round_even(median(w * h) / {FRAME}, 5)::DOUBLE FROM det d WHERE d.entity_id = q.entity_id) AS median_area_fraction FROM q""")
def box_structure(spark, sf):
    return structure.box_structure(detections(spark, sf), 500.0, 460.0)


PLACES = [("*/quick-cut/*", "quick_cut"), ("*000000?", "busy"), ("*reveal*", "nothing")]
FOLDERS = [("MACHINERY", "calm"), ("MACHINERY/2", "busy"), ("BUILDING", "missing")]
_PROFILES = [structure.Profile("calm"), structure.Profile("busy", 0.5, fps=18.0), structure.Profile("quick_cut", 0.7, True, 18.0), structure.Profile("scene"), structure.Profile("compilation", None, True, 12.0), structure.Profile("split_screen", None, True)]


@query("""WITH f AS (SELECT c_custkey, c_mktsegment || '/' || (c_nationkey % 5) AS folder, c_mktsegment || '/' || (c_nationkey % 5) || '/' || c_name AS path, c_name FROM customer)
 SELECT c_custkey, coalesce(CASE WHEN path GLOB '*000000?' OR c_name GLOB '*000000?' THEN 'busy' END, CASE WHEN folder = 'MACHINERY/2' THEN 'busy' WHEN folder LIKE 'MACHINERY/%' THEN 'calm' END) AS declared, CASE WHEN path GLOB '*000000?' THEN 'pattern' WHEN folder LIKE 'MACHINERY/%' THEN 'folder' END AS reason FROM f""", "")
def declared_profiles(spark, sf):
    f = table(spark, sf, "customer").withColumn("folder", F.concat_ws("/", "c_mktsegment", (F.col("c_nationkey") % 5).cast("string"))).withColumn("path", F.concat_ws("/", "folder", "c_name"))
    return structure.declared_profile(f, "path", "folder", _PROFILES, by_path=PLACES, by_folder=FOLDERS).select("c_custkey", "declared", "reason")


@query("""WITH f AS (SELECT c_custkey, c_nationkey % 8 AS p90, (c_custkey % 100) / 100.0::DOUBLE AS lf, c_custkey % 60 AS fr, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE (c_custkey % 97) / 97.0::DOUBLE END AS short, (c_custkey % 13) / 13.0::DOUBLE AS mid, c_custkey % 3 > 0 AS whole, CASE c_nationkey % 4 WHEN 0 THEN 'busy' WHEN 1 THEN 'compilation' WHEN 2 THEN NULL ELSE 'calm' END AS declared, CASE WHEN c_nationkey % 4 = 2 AND c_custkey % 2 = 0 THEN 'own' ELSE '' END AS folder FROM customer),
 r AS (SELECT *, CASE WHEN p90 >= 5 AND lf BETWEEN 0.4 AND 0.6 AND fr >= 30 THEN 'split_screen' WHEN short IS NULL THEN NULL WHEN short >= 0.7 THEN 'quick_cut' WHEN mid >= 0.375 THEN 'compilation' ELSE 'scene' END AS recommended FROM f),
 m AS (SELECT *, CASE recommended WHEN 'quick_cut' THEN 18 WHEN 'compilation' THEN 12 ELSE 10 END AS fto, CASE declared WHEN 'busy' THEN 18 WHEN 'compilation' THEN 12 ELSE 10 END AS fnow FROM r),
 w AS (SELECT *, CASE WHEN recommended <> 'split_screen' AND NOT whole THEN 'slice' WHEN declared IS NOT NULL AND fto < fnow THEN 'lower rate' WHEN declared = 'compilation' AND recommended <> 'split_screen' AND fto <= fnow THEN 'judgment' WHEN declared IS NULL AND folder <> '' THEN 'unmapped' END AS why FROM m)
 SELECT c_custkey, recommended, CASE WHEN recommended IS NULL THEN NULL WHEN why IS NULL THEN 'script' ELSE 'review' END AS move, CASE WHEN recommended IS NOT NULL THEN why END AS why FROM w""", "")
def folder_moves(spark, sf):
    c = table(spark, sf, "customer")
    f = c.selectExpr("c_custkey", "c_nationkey % 8 AS p90_simultaneous", "cast(c_custkey % 100 as double) / 100 AS left_half_fraction", "c_custkey % 60 AS frames_with_boxes", "if(c_custkey % 11 = 0, null, cast(c_custkey % 97 as double) / 97) AS short_shot_fraction", "cast(c_custkey % 13 as double) / 13 AS mid_shot_fraction", "c_custkey % 3 > 0 AS whole_file", "case c_nationkey % 4 when 0 then 'busy' when 1 then 'compilation' when 2 then null else 'calm' end AS declared", "if(c_nationkey % 4 = 2 and c_custkey % 2 = 0, 'own', '') AS folder")
    out = structure.move_verdict(structure.recommended(f, 0.7), _PROFILES, 10.0)
    return out.select("c_custkey", "recommended", "move", F.when(F.col("recommended").isNotNull(), F.col("why")).alias("why"))


@query(""", g AS (SELECT *, CASE WHEN t - lag(t) OVER o < 20000 - 1e-6 THEN 0 ELSE 1 END AS new FROM ev WINDOW o AS (PARTITION BY entity_id ORDER BY t)), b AS (SELECT *, sum(new) OVER (PARTITION BY entity_id ORDER BY t) AS k FROM g),
 c AS (SELECT entity_id, k, count(*) AS n, sum(t) AS s, max(t) AS last, max(t) - min(t) AS span FROM b GROUP BY 1, 2)
 SELECT entity_id, sum(CASE WHEN span > 60000 + 1e-6 THEN n ELSE 1 END)::BIGINT AS cuts, round(sum(CASE WHEN span > 60000 + 1e-6 THEN s ELSE last END), 2) AS at FROM c GROUP BY 1""", "ev")
def merged_cuts(spark, sf):
    cuts = structure.cut_arrays(timeline(spark, sf)).withColumn("m", tracking.cut_bursts_merged(F.col("cuts"), 20000.0, 60000.0))
    return cuts.select("entity_id", F.size("m").cast("long").alias("cuts"), F.round(F.aggregate("m", F.lit(0.0), lambda a, x: a + x), 2).alias("at"))


@query("""SELECT entity_id, max(x + w) AS wide, max(y + h) AS high FROM det GROUP BY 1""")
def frame_extent(spark, sf):
    return B.frame_of(detections(spark, sf), ["entity_id"])


@query("SELECT ['one', 'two', 'three', 'four'][l_linenumber + 1] AS class_id, count(*) AS n FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1", "")
def label_remap(spark, sf):
    return B.remapped(table(spark, sf, "lineitem"), ["one", "two", "three", "four"], "l_linenumber").groupBy("class_id").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT o_orderkey, o_totalprice - 100000 AS d, (o_custkey * 150)::DOUBLE AS f, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 50000.0::DOUBLE END AS m FROM orders), r AS (SELECT *, greatest(0, d - f) AS r FROM o)
 SELECT o_orderkey, CASE WHEN d > 0 AND r > 0 THEN round(CASE WHEN m > 0 THEN least(r, m) ELSE r END, 4) END AS scanned FROM r""", "")
def scanned_windows(spark, sf):
    o = table(spark, sf, "orders")
    most = F.when(F.col("o_orderkey") % 3 != 0, F.lit(50000.0))
    return o.select("o_orderkey", F.round(B.scanned_window(F.col("o_totalprice") - 100000, (F.col("o_custkey") * 150).cast("double"), most), 4).alias("scanned"))


@query("SELECT entity_id, round(sum(round_even(t + 0.1234, 3)), 2) AS at FROM ev GROUP BY 1", "ev")
def absolute_cuts(spark, sf):
    cuts = structure.cut_arrays(timeline(spark, sf)).withColumn("c", B.absolute_cuts(F.col("cuts"), F.lit(0.1234)))
    return cuts.select("entity_id", F.round(F.aggregate("c", F.lit(0.0), lambda a, x: a + x), 2).alias("at"))


@query(f""" SELECT a.class_id, count(*) FILTER (a.x <= b.x + b.w AND b.x <= a.x + a.w AND a.y <= b.y + b.h AND b.y <= a.y + a.h) AS touching, count(*) FILTER (a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h) AS overlapping,
 round(avg(sqrt((a.x + a.w / 2 - b.x - b.w / 2) ** 2 + (a.y + a.h / 2 - b.y - b.h / 2) ** 2)), 6) AS apart, round(avg(least(a.w, a.h) / 100), 6) AS feature_scale, count(DISTINCT round_even(a.t, 3)) AS instants FROM det a JOIN det b ON {_SAME} AND a.pos <> b.pos GROUP BY 1""")
def box_relations(spark, sf):
    p = stages.same_instant_pairs(detections(spark, sf)).withColumns({"w": F.col("a_w"), "h": F.col("a_h")}).withColumn("t", F.col("sample_index") / 10)
    scale = B.strength_scale(F.lit("feature"), F.lit(500))
    return p.groupBy(F.col("a_class_id").alias("class_id")).agg(F.count_if(B.touches("a_", "b_")).alias("touching"), F.count_if(B.touches("a_", "b_", True)).alias("overlapping"), r6(F.avg(B.centre_distance("a_", "b_"))).alias("apart"), r6(F.avg(scale)).alias("feature_scale"), F.countDistinct(B.time_key()).alias("instants"))


@query("""WITH e AS (SELECT vec_id, label, embedding AS a, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings) SELECT label, round(sum(list_sum(list_transform(range(1, len(a) + 1), lambda i: b[i]::DOUBLE * 0.75 + a[i]::DOUBLE * 0.25))), 2) AS total FROM e WHERE b IS NOT NULL GROUP BY 1""", "")
def cross_fade(spark, sf):
    from pyspark.sql import Window as W

    d = lambda c: F.transform(c, lambda x: x.cast("double"))
    e = table(spark, sf, "embeddings").select("label", d(F.col("embedding")).alias("a"), d(F.lag("embedding").over(W.partitionBy("label").orderBy("vec_id"))).alias("b")).where("b is not null")
    return e.groupBy("label").agg(F.round(F.sum(F.aggregate(tensor.faded(F.col("b"), F.col("a"), F.lit(0.25)), F.lit(0.0), lambda x, y: x + y)), 2).alias("total"))


@query(f""", RECURSIVE_ q AS (SELECT 'raw' AS stage, class_id, count(*) AS n FROM det GROUP BY 2 UNION ALL SELECT 'relevant', class_id, count(*) FROM det WHERE class_id <> 'label_c' GROUP BY 2
 UNION ALL SELECT 'suppressed', class_id, count(*) FROM det l WHERE class_id <> 'label_c' AND NOT (class_id = 'label_a' AND EXISTS (SELECT 1 FROM det b WHERE b.entity_id = l.entity_id AND b.sample_index = l.sample_index AND b.class_id = 'label_b' AND {_IOU.replace('a.', 'l.')} >= 0.3 AND b.score - l.score >= 0.1)) GROUP BY 2) SELECT * FROM q""")
def stage_counts(spark, sf):
    raw = detections(spark, sf)
    relevant = stages.relevant(raw, ["label_a", "label_b"])
    kept = stages.suppressed(relevant, RULES).where("by_pos is null")
    return stages.stage_counts(spark, {"raw": raw, "relevant": relevant, "suppressed": kept})


@query(f""", p AS (SELECT a.*, coalesce(bool_or(b.class_id = 'label_c' AND {_IOU} >= 0.6), false) AS t1, coalesce(bool_or(b.class_id = 'label_b' AND b.score >= 0.5 AND {_IOU} >= 0.5), false) AS e1, coalesce(bool_or(b.class_id = 'label_b' AND {_IOU} >= 0.5), false) AS t2, coalesce(bool_or(b.class_id = 'label_c' AND b.score >= 0.3), false) AS e2, coalesce(bool_or(b.class_id = 'label_b' AND {_IX} * {_IY} > 0), false) AS e3
 FROM det a LEFT JOIN det b ON {_SAME} AND a.pos <> b.pos GROUP BY ALL),
 o AS (SELECT *, CASE WHEN class_id <> 'label_a' OR score < 0.1 THEN NULL WHEN score >= 0.6 AND t1 THEN 'already_covered' WHEN score >= 0.6 AND e1 THEN 'promoted 0' WHEN t2 THEN 'already_covered' WHEN e2 AND e3 THEN 'promoted 1' ELSE 'no_evidence' END AS what FROM p)
 SELECT class_id, what, count(*) AS n, sum(sample_index * 10 + pos)::BIGINT AS rows FROM o GROUP BY 1, 2""")
def promote_chain(spark, sf):
    rules = [stages.Promotion("label_a", "label_c", 0.6, 0.6, (stages.Evidence("label_b", 0.5, min_iou=0.5),)), stages.Promotion("label_a", "label_b", 0.1, 0.5, (stages.Evidence("label_c", 0.3, anywhere=True), stages.Evidence("label_b")), need_all=True)]
    out = stages.promoted(detections(spark, sf), rules)
    what = F.when(F.col("outcome") == "promoted", F.concat(F.lit("promoted "), F.col("rule").cast("string"))).otherwise(F.col("outcome"))
    return out.groupBy("class_id", what.alias("what")).agg(F.count("*").alias("n"), F.sum(F.col("sample_index") * 10 + F.col("pos")).alias("rows"))


# --- catalog, run logs, orders ----------------------------------------------------------------------------------------------

_FILES = """WITH f AS (SELECT o_orderstatus AS backend, o_orderpriority AS sizes, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE 'v' || (o_custkey % 3) END AS variant, 'k' || (o_custkey % 4) AS key, CASE WHEN o_orderkey % 5 = 0 THEN '-preview@' || (o_orderkey % 2) ELSE '' END AS preview, o_custkey AS entity_id, 9 + (o_orderkey % 2) * 9 AS rate, o_orderkey % 2 AS version, 0.12::DOUBLE + (o_orderkey % 3) * 0.0004::DOUBLE AS floor FROM orders)"""


def _files(spark, sf):
    return table(spark, sf, "orders").selectExpr("o_orderstatus AS backend", "o_orderpriority AS sizes", "if(o_custkey % 3 = 0, null, concat('v', o_custkey % 3)) AS variant", "concat('k', o_custkey % 4) AS key", "if(o_orderkey % 5 = 0, concat('-preview@', o_orderkey % 2), '') AS preview", "o_custkey AS entity_id", "9 + (o_orderkey % 2) * 9 AS rate", "o_orderkey % 2 AS version", "0.12D + (o_orderkey % 3) * 0.0004D AS floor")


@query(_FILES + " SELECT backend, count(*) AS n, count(DISTINCT entity_id) AS entities FROM f WHERE backend IN ('F', 'O') AND version = 1 AND abs(floor - 0.12) <= 5e-4 AND preview = '' GROUP BY 1", "")
def all_caches(spark, sf):
    return catalog.all_caches(_files(spark, sf), ["F", "O"], 1, 0.12).groupBy("backend").agg(F.count("*").alias("n"), F.countDistinct("entity_id").alias("entities"))


@query(_FILES + """, g AS (SELECT backend, sizes, coalesce('v:' || variant, 'k:' || key) AS identity, preview <> '' AS p, list_sort(list(DISTINCT key)) AS keys, count(DISTINCT entity_id) AS entities, list_sort(list(DISTINCT rate::VARCHAR)) AS rates, min(preview) AS lo, max(preview) AS hi FROM f GROUP BY 1, 2, 3, 4)
 SELECT backend, sizes, identity, array_to_string(keys, ',') AS keys, entities, array_to_string(rates, ',') AS rates, CASE WHEN NOT p THEN '' WHEN lo = hi THEN lo ELSE '-preview*' END AS preview FROM g""", "")
def merged_configurations(spark, sf):
    return catalog.merged_configurations(_files(spark, sf))


@query("""SELECT o_custkey AS entity_id, o_orderkey AS path FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus <> 'F', o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1""", "")
def cut_caches(spark, sf):
    s = table(spark, sf, "orders").select(F.col("o_custkey").alias("entity_id"), F.when(F.col("o_orderstatus") != "F", F.lit(20.0)).alias("most_seconds"), F.col("o_orderdate").alias("written"), F.col("o_orderkey").alias("path"))
    return catalog.cut_cache(s).select("entity_id", "path")


@query("""WITH r AS (SELECT o_custkey AS name, bool_or(o_orderstatus = 'F') AS decided, bool_or(o_orderstatus = 'O') AS ranked, count(*) > 8 AS recorded, count(*) FILTER (o_totalprice > 200000) AS renders, round(coalesce(sum(o_totalprice) FILTER (o_totalprice > 200000), 0), 2) AS bytes, round(sum(o_totalprice), 2) AS all_bytes, max(epoch(o_orderdate)) AS changed FROM orders GROUP BY 1),
 c AS (SELECT *, CASE WHEN decided THEN CASE WHEN renders > 0 THEN 'decided_renders' END WHEN ranked THEN CASE WHEN renders > 0 AND 1.0e9 - changed >= 14 * 86400 THEN 'stale_renders' END WHEN renders = 0 AND NOT recorded AND 1.0e9 - changed >= 3600 THEN 'aborted_rounds' END AS category FROM r) SELECT name, category, CASE category WHEN 'aborted_rounds' THEN all_bytes ELSE bytes END AS bytes FROM c WHERE category IS NOT NULL""", "")
def removable_rounds(spark, sf):
    p = F.col("o_totalprice")
    r = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("name")).agg(F.bool_or(F.col("o_orderstatus") == "F").alias("decided"), F.bool_or(F.col("o_orderstatus") == "O").alias("ranked"), (F.count("*") > 8).alias("recorded"), F.count_if(p > 200000).alias("renders"), F.round(F.coalesce(F.sum(F.when(p > 200000, p)), F.lit(0.0)), 2).alias("bytes"), F.round(F.sum(p), 2).alias("files_bytes"), F.max(F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).alias("changed"))
    return catalog.removable(r, 1.0e9)


@query("""SELECT e.k AS entity_id, count(*) FILTER (r.i >= CASE WHEN e.k % 3 = 0 THEN 0 ELSE e.k END) AS left_over FROM (SELECT n_nationkey AS k FROM nation) e JOIN range(60) r(i) ON r.i < 20 + e.k GROUP BY 1""", "")
def resume_points(spark, sf):
    e = table(spark, sf, "nation").select(F.col("n_nationkey").alias("entity_id"))
    samples = e.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("entity_id") + 19)))
    saved = e.select("entity_id", F.when(F.col("entity_id") % 3 != 0, F.col("entity_id")).alias("next_sample"))
    return catalog.resume_points(samples, saved).groupBy("entity_id").agg(F.count("*").alias("left_over"))


@query("""SELECT c.c_custkey AS k, coalesce((SELECT max(o_orderkey) FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'F'), (SELECT max(o_orderkey) FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'O'), -1) AS v FROM customer c""", "")
def with_fallback(spark, sf):
    o = table(spark, sf, "orders")
    part = lambda s: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("v"))
    return catalog.with_fallback(table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), part("F"), part("O"), "k", "v").fillna(-1, ["v"])


@query("""WITH c AS (SELECT c_custkey, round(c_acctbal, 0) AS d FROM customer), s AS (SELECT c_custkey, unnest(CASE WHEN d > 20 THEN list_distinct([round_even((d - 20) * 1 / 4.0::DOUBLE, 1), round_even((d - 20) * 2 / 4.0::DOUBLE, 1), round_even((d - 20) * 3 / 4.0::DOUBLE, 1)]) ELSE [0.0::DOUBLE] END) AS s FROM c) SELECT c_custkey, count(*) AS slices, round(sum(s), 1) AS at FROM s GROUP BY 1""", "")
def slice_plan(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.round("c_acctbal", 0).alias("d"))
    return catalog.slices(c, "d", 3, 20.0).groupBy("c_custkey").agg(F.count("*").alias("slices"), F.round(F.sum("slice_start"), 1).alias("at"))


@query("""SELECT c_custkey, left(md5('{"name":"' || c_name || '","nation":' || c_nationkey || '}'), 6) AS settings, right(md5(c_name), 16) AS content FROM customer""", "")
def catalog_keys(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", catalog.settings_key(F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))).alias("settings"), catalog.content_key(F.col("c_name")).alias("content"))


@query("""WITH m AS (SELECT o_orderpriority AS p, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1, 2) SELECT o_orderpriority, count(*) AS files, count(*) * 2 AS listed, bool_or(o_totalprice > 400000) AS any_large, (SELECT n FROM m WHERE m.p = o_orderpriority AND s = 'F')::BIGINT AS failed FROM orders GROUP BY 1""", "")
def merged_counts(spark, sf):
    o = table(spark, sf, "orders").select("o_orderpriority", F.lit(1).cast("long").alias("files"), F.array("o_orderkey", "o_custkey").alias("listed"), (F.col("o_totalprice") > 400000).alias("any_large"), F.create_map("o_orderstatus", F.lit(1).cast("long")).alias("counts"))
    m = runs.merged_counts(o, ["o_orderpriority"], ["files"], ["listed"], ["any_large"], ["counts"])
    return m.select("o_orderpriority", "files", F.size("listed").cast("long").alias("listed"), "any_large", F.col("counts")["F"].alias("failed"))


@query("""SELECT o_custkey, total FROM (SELECT o_custkey, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS total FROM orders GROUP BY 1) WHERE total > 0 ORDER BY total DESC, o_custkey LIMIT 12""", "")
def most_changed(spark, sf):
    t = table(spark, sf, "orders").groupBy("o_custkey").agg(F.round(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))), 2).alias("total"))
    return review.top_by(t, "o_custkey", "total", 12)


@query("""WITH t AS (SELECT c_custkey, c_acctbal, CASE WHEN c_nationkey % 4 = 0 THEN NULL ELSE c_nationkey END AS content FROM customer WHERE c_acctbal > 0), r AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY c_acctbal DESC, c_custkey) AS k FROM t) SELECT c_custkey, c_acctbal FROM r WHERE content IS NULL OR k = 1 ORDER BY c_acctbal DESC, c_custkey LIMIT 10""", "")
def distinct_top(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", F.when(F.col("c_nationkey") % 4 != 0, F.col("c_nationkey")).alias("content"))
    return review.distinct_top(c, "c_custkey", "c_acctbal", "content", 10).select("c_custkey", "c_acctbal")


_TIERS = [("shared", "label_a", "min_prob", 0.3), ("backend", "label_a", "min_prob", 0.4), ("variant", "label_a", "look", 1.0), ("variant", "label_a", "min_prob", 0.5), ("profile", "label_b", "min_prob", 0.6), ("shared", "label_b", "look", 2.0), ("backend", "label_b", "look", 3.0), ("shared", "label_b", "min_prob", 0.2)]
_TIER_SQL = ", ".join(f"('{a}', '{b}', '{c}', {d}::DOUBLE)" for a, b, c, d in _TIERS)


@query(f""", t AS (SELECT * FROM (VALUES {_TIER_SQL}) x(tier, label, name, value) WHERE tier = 'shared' OR name = 'min_prob'), b AS (SELECT label, name, arg_max(value, list_position(['shared', 'backend', 'variant', 'profile'], tier)) AS value FROM t GROUP BY 1, 2)
 SELECT b.label, b.name, b.value, count(d.pos) AS n FROM b LEFT JOIN det d ON d.class_id = b.label AND b.name = 'min_prob' AND d.score > b.value GROUP BY 1, 2, 3""")
def settings_tiers(spark, sf):
    t = spark.createDataFrame(_TIERS, "tier string, label string, name string, value double")
    s = review.settings_of(review.whitelisted(t, dict.fromkeys(("backend", "variant", "profile"), ["min_prob"])), ["shared", "backend", "variant", "profile"])
    d = detections(spark, sf).select("class_id", "score", "pos")
    j = F.broadcast(s).join(d, (F.col("class_id") == F.col("label")) & (F.col("name") == "min_prob") & (F.col("score") > F.col("value")), "right")  # a list of the program
    counts = j.where("label is not null").groupBy("label", "name").agg(F.count("*").alias("n"))
    return s.select("label", "name", "value").join(counts, ["label", "name"], "left").fillna(0, ["n"])


# --- people, windows, merges ------------------------------------------------------------------------------------------------


def _people(spark, sf):
    return detections(spark, sf).where("class_id = 'label_c'").select("entity_id", "t", F.col("pos").cast("long").alias("person"), *"xywh")


@query(""", p AS (SELECT * FROM det WHERE class_id = 'label_c'), e AS (SELECT d.entity_id, d.sample_index, d.pos, CASE d.class_id WHEN 'label_a' THEN 'one_kind' ELSE 'other_kind' END AS kind, count(p.pos) AS n FROM det d LEFT JOIN p ON p.entity_id = d.entity_id AND p.sample_index = d.sample_index AND d.x + d.w / 2 >= p.x AND d.x + d.w / 2 < p.x + p.w AND d.y + d.h / 2 >= p.y AND d.y + d.h / 2 < p.y + p.h WHERE d.class_id <> 'label_c' GROUP BY 1, 2, 3, 4)
 SELECT kind, CASE WHEN n = 0 THEN 'outside' WHEN n = 1 THEN 'one' ELSE 'shared' END AS place, count(*) AS n FROM e GROUP BY 1, 2""")
def people_evidence(spark, sf):
    found = people.evidence(_people(spark, sf), detections(spark, sf), {"label_a": "one_kind", "label_b": "other_kind"})
    return found.groupBy("kind", "place").agg(F.count("*").alias("n"))


@query()
def people_attribution(spark, sf):
    p = _people(spark, sf)
    found = people.evidence(p, detections(spark, sf), {"label_a": "one_kind", "label_b": "other_kind"})
    return people.tally(people.attributed(people.linked(p, 0.3, 1.0), found, "one_kind", "other_kind"))


@query(""", s AS (SELECT entity_id, t, label = 'view' AS shown FROM ev), g AS (SELECT k.entity_id, (x.i * 3600)::DOUBLE AS t FROM (SELECT DISTINCT entity_id FROM ev) k CROSS JOIN range(24 * 31) x(i)),
 b AS (SELECT g.entity_id, g.t, p.t AS bt, p.shown AS bs FROM g ASOF LEFT JOIN s p ON p.entity_id = g.entity_id AND p.t <= g.t), c AS (SELECT b.*, n.t AS nt, n.shown AS ash FROM b ASOF LEFT JOIN s n ON n.entity_id = b.entity_id AND n.t > b.t),
 d AS (SELECT entity_id, CASE WHEN t - bt <= 0.02 THEN CASE WHEN bs THEN bt END WHEN nt - t <= 0.02 THEN CASE WHEN ash THEN nt END WHEN nt - bt <= 1.5 * 40000 AND bs AND ash THEN bt END AS before FROM c) SELECT entity_id, count(before) AS shown, round(coalesce(sum(before), 0), 2) AS total FROM d GROUP BY 1""", "ev")
def people_shown(spark, sf):
    ev = timeline(spark, sf)
    grid = ev.select("entity_id").distinct().select("entity_id", F.explode(F.sequence(F.lit(0), F.lit(24 * 31 - 1))).alias("i")).select("entity_id", (F.col("i") * 3600).cast("double").alias("t"))
    out = people.shown_at(ev.select("entity_id", "t", (F.col("label") == "view").alias("shown")), grid, 1 / 40000)
    return out.groupBy("entity_id").agg(F.count("before").alias("shown"), F.round(F.coalesce(F.sum("before"), F.lit(0.0)), 2).alias("total"))


@query()
def busiest_windows(spark, sf):
    d = detections(spark, sf)
    spans = d.select("entity_id", F.greatest(F.col("t") - 0.2, F.lit(0.0)).alias("start"), (F.col("t") + 0.2).alias("stop"))
    return review.top_windows(spans, d.groupBy("entity_id").agg((F.max("t") + 1).alias("duration")), 5.0, 3)


@query(""", p AS (SELECT entity_id, sample_index, class_id, count(*) AS n, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1 FROM det GROUP BY 1, 2, 3),
 m AS (SELECT class_id, trunc(x0 - x0 * 0.1) AS x, greatest(1, trunc((x1 + (500 - x1) * 0.1) - (x0 - x0 * 0.1))) AS w, greatest(1, trunc(y1 - y0)) AS h FROM p WHERE n = 2 UNION ALL SELECT d.class_id, d.x, d.w, d.h FROM det d JOIN p USING (entity_id, sample_index, class_id) WHERE p.n <> 2)
 SELECT class_id, count(*) AS boxes, round(sum(x), 2) AS x, round(sum(w), 2) AS w, round(sum(h), 2) AS h FROM m GROUP BY 1""")
def spanned_boxes(spark, sf):
    out = tracking.merged_boxes(detections(spark, sf), ["entity_id", "sample_index", "class_id"], "span", 0.1, 500.0)
    return out.groupBy("class_id").agg(F.count("*").alias("boxes"), *[F.round(F.sum(c), 2).alias(c) for c in "xwh"])


@query()
def touching_merged(spark, sf):
    out = tracking.merged_boxes(detections(spark, sf), ["entity_id", "sample_index"], "single-pass")
    return out.groupBy("entity_id").agg(F.count("*").alias("boxes"), F.round(F.sum(F.col("w") * F.col("h")), 2).alias("area"))


@query(""", g AS (SELECT *, floor(t) AS now, (max(x + w) OVER k - min(x) OVER k) * (max(y + h) OVER k - min(y) OVER k) AS u, max(w * h) OVER k AS l FROM det WINDOW k AS (PARTITION BY entity_id, class_id, floor(t))),
 r AS (SELECT *, row_number() OVER (PARTITION BY entity_id, class_id, now ORDER BY (t > now)::INT, t DESC, pos) AS k FROM g) SELECT class_id, count(*) AS n, sum(pos)::BIGINT AS pos FROM r WHERE NOT (l > 0 AND u <= l * 4) OR k = 1 GROUP BY 1""")
def collapsed_samples(spark, sf):
    d = detections(spark, sf).withColumn("now", F.floor("t"))
    return tracking.collapsed(d, "now", ["entity_id", "class_id"], 4.0).groupBy("class_id").agg(F.count("*").alias("n"), F.sum("pos").alias("pos"))


@query("""SELECT user_id AS entity_id, epoch(w)::BIGINT AS window_start, count(*) AS n FROM (SELECT user_id, ts, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS w FROM events) WHERE w + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1, 2""", "")
def stream_sliding(spark, sf):
    out = live.available_now(live.windowed(live.event_stream(spark, sf), ["entity_id"], "at", "1 day", "1 hour", "12 hours"))
    return out.select("entity_id", F.unix_seconds("window_start").alias("window_start"), "n")


@query("""WITH g AS (SELECT user_id AS entity_id, ts, CASE WHEN ts - lag(ts) OVER o < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY entity_id ORDER BY ts) AS k FROM g)
 SELECT entity_id, floor(epoch(min(ts)))::BIGINT AS session_start, count(*) AS n FROM s GROUP BY entity_id, k HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""", "")
def stream_sessions(spark, sf):
    out = live.available_now(live.sessions(live.event_stream(spark, sf), ["entity_id"], "at", "6 hours", "1 hour"))
    return out.select("entity_id", F.unix_seconds("session_start").alias("session_start"), "n")
