"""Decisions from measured runs: replay metrics, prices of looser settings, rule suggestions and their verdicts.

Rows are candidates of a setting, one for each configuration; decisions are conditional columns and small aggregates over them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.boxes import area
from . import diff, stages, stats

#: Limits of the decisions.
MOST_PRICE, MOST_LOSS, MOST_CONFIDENT_LOSS, MOST_GROWTH, TIGHT_LOSS = 5.0, 0.005, 0.001, 0.25, 0.0001
#: Overlaps below this IoU are two things side by side; a pair whose suppressor wins less often isn't worth a rule.
ADJACENT, LEAST_WINS = 0.20, 0.2


def replay_metrics(rendered: DataFrame, detections: DataFrame, frame: float, labels: list[str], confident: float = 0.5, bucket: float = 0.5) -> DataFrame:
    """Per label of `labels` (A21): rendered boxes, coverage in area seconds, confident detections and those that no rendered box covers; zeros for labels without any.

    rendered: entity_id, class_id, start, stop and a box."""
    boxes = rendered.where(F.col("class_id").isin(*labels))
    cover = boxes.groupBy("class_id").agg(F.count("*").alias("rendered"), F.sum(area() / frame * F.greatest(F.col("stop") - F.col("start"), F.lit(0.0))).alias("coverage"))
    sure = detections.where(F.col("class_id").isin(*labels) & (F.col("score") >= confident))
    spans = boxes.select("entity_id", "class_id", "start", "stop", *[F.col(c).cast("double").alias(f"b{c}") for c in "xywh"])
    missed = diff.uncovered(sure, spans, bucket).groupBy("class_id").agg(F.count("*").alias("uncovered"))
    every = rendered.sparkSession.createDataFrame([(n,) for n in labels], "class_id string")  # a list of the program
    out = every.join(cover, "class_id", "left").join(sure.groupBy("class_id").agg(F.count("*").alias("confident")), "class_id", "left").join(missed, "class_id", "left")
    return out.fillna(0, ["rendered", "confident", "uncovered"]).fillna(0.0, ["coverage"])


def worst_loss(before: DataFrame, after: DataFrame, keys: list[str], label: str = "class_id", value: str = "coverage") -> DataFrame:
    """Per keys the largest share of coverage that a label loses, 0 if none does."""
    return diff.coverage_change(before, after, [*keys, label], value).groupBy(*keys).agg(F.greatest(F.lit(0.0), -F.min("change")).alias("worst_loss"))


def priced(rows: DataFrame, keys: list[str], most_price: float = MOST_PRICE, most_loss: float = MOST_LOSS) -> DataFrame:
    """Candidates with resets avoided, risky matches added, their price and a verdict.

    rows: keys, value, is_baseline, new_tracks, risky, coverage_loss; one baseline row a key."""
    base = rows.where("is_baseline").select(*keys, F.col("new_tracks").alias("_n"), F.col("risky").alias("_r"))
    c = rows.where("not is_baseline").join(base, keys).withColumns({"resets_avoided": F.col("_n") - F.col("new_tracks"), "risky_added": F.col("risky") - F.col("_r")})
    c = c.withColumn("price", F.when(F.col("resets_avoided") > 0, F.col("risky_added") / F.col("resets_avoided")))
    verdict = F.when(F.col("coverage_loss") > most_loss, "coverage").when(F.col("resets_avoided") <= 0, "no_gain").when(F.col("price") > most_price, "price").otherwise("eligible")
    return c.withColumn("verdict", verdict).drop("_n", "_r")


def chosen_value(scored: DataFrame, keys: list[str], configuration: str) -> DataFrame:
    """Per keys the value that is eligible in every configuration and avoids most resets in all, the smallest of equals; null if none is."""
    n = scored.groupBy(*keys).agg(F.countDistinct(configuration).alias("_all"))
    v = scored.groupBy(*keys, "value").agg(F.countDistinct(F.when(F.col("verdict") == "eligible", F.col(configuration))).alias("_n"), F.sum("resets_avoided").alias("avoided")).join(n, keys)
    ok = v.where("_n = _all").groupBy(*keys).agg(F.min(F.struct((-F.col("avoided")).alias("a"), "value")).alias("best"))
    return n.join(ok, keys, "left").select(*keys, F.col("best.value").alias("value"), (-F.col("best.a")).alias("resets_avoided"))


def split_values(scored: DataFrame, keys: list[str], configuration: str) -> DataFrame:
    """Each configuration's own best eligible value, where at least two have one and they disagree."""
    best = scored.where("verdict = 'eligible'").groupBy(*keys, configuration).agg(F.min(F.struct((-F.col("resets_avoided")).alias("a"), "value"))["value"].alias("value"))
    wants = best.groupBy(*keys).agg(F.countDistinct(configuration).alias("_c"), F.countDistinct("value").alias("_v")).where("_c >= 2 and _v >= 2")
    return best.join(wants.select(*keys), keys)


def strictest(rows: DataFrame, keys: list[str], most_loss: float = MOST_LOSS, most_confident: float = MOST_CONFIDENT_LOSS, most_growth: float = MOST_GROWTH) -> DataFrame:
    """Per keys the strictest value that leaves hardly more confident detections bare than the fewest.

    rows: keys, value (the larger the stricter), is_baseline, missed, total, coverage_loss; of several configurations they are pooled. Values that lose coverage are out;
    so are stricter ones that leave most_growth more bare than the baseline. Where every value leaves as many, or nothing is within, the baseline stays.
    """
    p = rows.groupBy(*keys, "value").agg(F.max("is_baseline").alias("base"), F.sum("missed").alias("missed"), F.sum("total").alias("total"), F.max("coverage_loss").alias("loss"))
    g = p.groupBy(*keys).agg(F.countDistinct("missed").alias("_kinds"), F.max("total").alias("_total"), F.min(F.when(F.col("loss") <= most_loss, F.col("missed"))).alias("_floor"), F.max(F.when(F.col("base"), F.col("missed"))).alias("_held"), F.max(F.when(F.col("base"), F.col("value"))).alias("baseline"))
    j = p.join(g, keys)
    within = (F.col("loss") <= most_loss) & (F.col("missed") <= F.col("_floor") + most_confident * F.col("_total")) & ~((F.col("value") > F.col("baseline")) & (F.col("missed") > F.col("_held") * (1 + most_growth)))
    out = j.groupBy(*keys).agg(F.max(F.when(within, F.col("value"))).alias("_v"), F.max("baseline").alias("baseline"), F.max("_kinds").alias("_kinds"))
    return out.select(*keys, "baseline", F.when(F.col("_kinds") > 1, F.coalesce("_v", "baseline")).otherwise(F.col("baseline")).alias("value"))


def tighter_to_review(scored: DataFrame, keys: list[str], tolerance: float = TIGHT_LOSS) -> DataFrame:
    """Per keys the value below the baseline that removes most risky matches at no loss of coverage and at least one for each reset it adds; the first (smallest) of equals.

    scored: keys, value, baseline, risky_added, resets_avoided, coverage_loss."""
    removed, added = -F.col("risky_added"), -F.col("resets_avoided")
    ok = (F.col("value") < F.col("baseline")) & (F.col("coverage_loss") <= tolerance) & (removed > 0) & (removed >= added)
    best = scored.where(ok).groupBy(*keys).agg(F.min(F.struct((-removed).alias("r"), "value", added.alias("a"))).alias("b"))
    return best.select(*keys, F.col("b.value").alias("value"), (-F.col("b.r")).alias("risky_removed"), F.col("b.a").alias("resets_added"))


def burst_verdict(changes: DataFrame, most_price: float = MOST_PRICE) -> DataFrame:
    """Variants with price and whether they help (R10): confident detections restored, and few risky matches for each. changes: variant, restored, risky_added."""
    price = F.when(F.col("restored") > 0, F.greatest(F.col("risky_added"), F.lit(0)) / F.col("restored"))
    return changes.withColumn("price", price).withColumn("helps", F.coalesce((F.col("restored") > 0) & (price <= most_price), F.lit(False)))


def best_variant(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys the helping variant that restores most, then adds fewest risky matches, the first by name of equals."""
    return verdicts.where("helps").groupBy(*keys).agg(F.min(F.struct((-F.col("restored")).alias("r"), F.col("risky_added").alias("a"), "variant"))["variant"].alias("variant"))


def suggested_rules(pairs: DataFrame, least: int = 30) -> DataFrame:
    """Per (label, suppressor) with at least `least` overlaps (A9): n, share of overlaps the suppressor wins, the IoU valley as min_iou, median lead among same-spot wins as margin, same-spot overlaps and wins.

    pairs: label, suppressor, iou, margin of overlapping detections of different labels."""
    keys = ["label", "suppressor"]
    bins = stats.VALLEY_BINS
    n = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.when(F.col("margin") > 0, 1.0).otherwise(0.0)).alias("win_rate")).where(F.col("n") >= least)
    v = stats.valley(stats.histogram(pairs, keys, "iou", 0.0, 1.0, bins), keys)
    spot = pairs.join(v.where("valley is not null"), keys).where(F.col("iou") >= F.col("valley"))
    s = spot.groupBy(*keys).agg(F.count("*").alias("same_spot"), F.count_if(F.col("margin") > 0).alias("wins"))
    m = stats.at_ranks(spot.where("margin > 0"), keys, "margin", {"_lo": lambda k: F.floor((k - 1) / 2), "_hi": lambda k: F.floor(k / 2)}).select(*keys, F.bround((F.col("_lo") + F.col("_hi")) / 2, 3).alias("_m"))
    out = n.join(v, keys, "left").join(s, keys, "left").join(m, keys, "left")
    found = F.col("valley").isNotNull()
    return out.select(*keys, "n", "win_rate", F.col("valley").alias("min_iou"), F.when(found, F.coalesce("_m", F.lit(0.0))).alias("margin"), "same_spot", F.when(found, F.col("wins") / F.col("same_spot")).alias("same_spot_wins"))


def additions(suggested: DataFrame, configured: list[tuple[str, str]], refused: list[tuple[str, str]], least_wins: float = LEAST_WINS) -> DataFrame:
    """Suggested rules of pairs that have no rule yet, aren't refused and whose suppressor wins often enough."""
    out = [(a, b) for a, b in [*configured, *refused]]
    known = suggested.sparkSession.createDataFrame(out, "label string, suppressor string") if out else None
    found = suggested.where(F.col("min_iou").isNotNull() & (F.col("same_spot_wins") >= least_wins))
    return found if known is None else found.join(F.broadcast(known), ["label", "suppressor"], "left_anti")  # a list of the program


def suppression_impact(df: DataFrame, rule_sets: dict[str, list[tuple[str, str, float, float]]], min_prob: dict[str, float]) -> DataFrame:
    """For each rule set and rule: removed rows, those of them over their label's min_prob (renderable), and those that stood side by side with what removed them."""
    out = None
    gate = F.create_map(*[x for k, v in min_prob.items() for x in (F.lit(k), F.lit(float(v)))])
    for name, rules in rule_sets.items():
        if not rules:
            continue
        hit = stages.suppressed(df, rules, with_iou=True).where("by_pos is not null")
        over = F.coalesce(F.col("score") > F.try_element_at(gate, F.col("class_id")), F.lit(False))
        part = hit.groupBy(F.lit(name).alias("rule_set"), F.concat(F.col("class_id"), F.lit("<-"), F.col("by_label")).alias("rule")).agg(F.count("*").alias("removed"), F.count_if(over).alias("renderable"), F.count_if(over & (F.col("by_iou") < ADJACENT)).alias("side_by_side"))
        out = part if out is None else out.unionByName(part)
    return out


def rule_changes(current: DataFrame, proposed: DataFrame) -> DataFrame:
    """Each pair of two rule sets (label, suppressor, min_iou, margin) and what becomes of it: dropped, added, unchanged or retuned."""
    keys = ["label", "suppressor"]
    a = current.select(*keys, F.col("min_iou").alias("a_iou"), F.col("margin").alias("a_margin"), F.lit(True).alias("a"))
    b = proposed.select(*keys, F.col("min_iou").alias("b_iou"), F.col("margin").alias("b_margin"), F.lit(True).alias("b"))
    same = F.col("a_iou").eqNullSafe(F.col("b_iou")) & F.col("a_margin").eqNullSafe(F.col("b_margin"))
    return a.join(b, keys, "full").select(*keys, F.when(F.col("b").isNull(), "dropped").when(F.col("a").isNull(), "added").when(same, "unchanged").otherwise("retuned").alias("change"))


def winners(tally: DataFrame, keys: list[str]) -> DataFrame:
    """The side that most verdicts favour (A35): proposed only if strictly more do; current otherwise, told apart where nothing was judged. tally: keys, current, proposed."""
    c, p = F.coalesce("current", F.lit(0)), F.coalesce("proposed", F.lit(0))
    return tally.select(*keys, F.when(p > c, "proposed").when(c > 0, "current").otherwise("current (no verdict yet)").alias("winner"))


#: Fixed values of the rule proposal: overlaps needed, share of a histogram that makes a cluster, percentages aimed at.
PROPOSAL_PAIRS, CLUSTER, HIGH_START, MARGIN_SHARE, MARGIN_LEAST = 20, 0.15, 25, 33, 30


def parsed_report(lines: DataFrame, text: str = "block") -> DataFrame:
    """Blocks of a pair report as rows (R9): label, suppressor, pairs, overlaps, iou_median, delta_median, thresholds and delta_thresholds (arrays of value and percentage), bimodal."""
    b = F.col(text)
    num = lambda pattern, kind: F.nullif(F.regexp_extract(b, pattern, 1), F.lit("")).cast(kind)
    steps = lambda name: F.transform(F.expr(f"regexp_extract_all({text}, '{name} >= (-?[0-9.]+): [0-9]+/[0-9]+ \\\\([0-9]+%\\\\)', 0)"), lambda x: F.struct(F.regexp_extract(x, ">= (-?[0-9.]+):", 1).cast("double").alias("at"), F.regexp_extract(x, r"\((\d+)%\)", 1).cast("int").alias("pct")))
    hist = F.transform(F.expr(f"regexp_extract_all({text}, '\\\\[[0-9.]+-[0-9.]+\\\\): *([0-9]+)', 1)"), lambda x: x.cast("long"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    d = lines.select(F.regexp_extract(b, r"^(\S+) suppressed_by", 1).alias("label"), F.regexp_extract(b, r"^\S+ suppressed_by (\S+):", 1).alias("suppressor"), b.contains("no same-instant").alias("_none"), num(r"same-instant pairs found:\s*(\d+)", "long").alias("pairs"), num(r"of which actually overlapping:\s*(\d+)", "long").alias("overlaps"), num(r"IoU, overlapping pairs only:\s*n=\d+\s+min=-?[\d.]+\s+median=(-?[\d.]+)", "double").alias("iou_median"), num(r"score\(\S+\) - score\(\S+\), overlapping pairs only:\s*n=\d+\s+min=-?[\d.]+\s+median=(-?[\d.]+)", "double").alias("delta_median"), steps("IoU").alias("thresholds"), steps("score delta").alias("delta_thresholds"), hist.alias("_h"))
    share = lambda a: total(a) / F.greatest(total(F.col("_h")), F.lit(1))
    bimodal = (F.size("_h") > 0) & (share(F.slice("_h", 1, 2)) >= CLUSTER) & (share(F.slice("_h", 9, 2)) >= CLUSTER)
    d = d.where((F.col("label") != "") & (F.col("_none") | F.col("pairs").isNotNull()))
    return d.withColumns({"bimodal": bimodal, "pairs": F.coalesce("pairs", F.lit(0).cast("long")), "overlaps": F.coalesce("overlaps", F.lit(0).cast("long"))}).drop("_none", "_h")


def proposed_rules(report: DataFrame) -> DataFrame:
    """A rule for each row of parsed_report that has enough overlaps (R9): min_iou from the high cluster's start if there are two clusters, else the tested value nearest the median; margin
    the tested value that about a third of overlaps clear, or 0 where the suppressor rarely leads."""
    steps, deltas = F.array_sort("thresholds"), F.array_sort("delta_thresholds")
    starts = F.filter(steps, lambda x: x["pct"] <= HIGH_START)
    high = F.when(F.size(starts) > 0, F.element_at(starts, 1)["at"]).otherwise(F.element_at(steps, 1)["at"])
    near = F.array_min(F.transform(steps, lambda x: F.struct(F.abs(x["at"] - F.col("iou_median")).alias("d"), x["at"].alias("at"))))["at"]
    iou_ = F.when((F.col("overlaps") >= PROPOSAL_PAIRS) & (F.size("thresholds") > 0), F.when(F.col("bimodal"), high).when(F.col("iou_median").isNotNull(), near))
    at_zero = F.filter(deltas, lambda x: x["at"] == 0.0)
    third = F.array_min(F.transform(deltas, lambda x: F.struct(F.abs(x["pct"] - MARGIN_SHARE).alias("d"), x["at"].alias("at"))))["at"]
    rare = (F.size(at_zero) > 0) & (F.element_at(F.concat(at_zero, F.array(F.struct(F.lit(0.0).alias("at"), F.lit(100).alias("pct")))), 1)["pct"] < MARGIN_LEAST)
    margin = F.when((F.size("delta_thresholds") > 0) & F.col("delta_median").isNotNull(), F.when(rare, F.lit(0.0)).otherwise(third))
    return report.select("label", "suppressor", iou_.alias("min_iou"), F.when(iou_.isNotNull(), margin).alias("margin"))


def overlapping_pairs(df: DataFrame) -> DataFrame:
    """label, suppressor, iou, margin of overlapping detections of different labels at an instant."""
    p = stages.same_instant_pairs(df).where("a_class_id <> b_class_id and iou > 0")
    return p.select(F.col("a_class_id").alias("label"), F.col("b_class_id").alias("suppressor"), "iou", (F.col("b_score") - F.col("a_score")).alias("margin"))


def faults(settings: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Every breach of the rules at once (R12): name, value and fault of settings (name, value as text). rules: (name, SQL condition on number or value, fault), a list in the program."""
    d = settings.withColumn("number", F.expr("try_cast(value as double)"))
    each = F.array(*[F.when((F.col("name") == n) & ~F.coalesce(F.expr(cond), F.lit(False)), F.lit(fault)) for n, cond, fault in rules])
    known = sorted({n for n, *_ in rules})
    unknown = F.when(~F.col("name").isin(*known), F.array(F.lit("unknown setting"))).otherwise(F.array().cast("array<string>"))
    return d.select("name", "value", F.explode(F.concat(unknown, F.filter(each, lambda x: x.isNotNull()))).alias("fault"))


def style_variety(found: DataFrame) -> DataFrame:
    """Per label: looks drawn anew, those beside another live track of another look, and those with a near neighbour (A34). found: the output of tracking() with styles."""
    new = found.where("kind = 'new'")
    return new.groupBy("class_id").agg(F.count("*").alias("resolves"), F.countDistinct("style").alias("looks"), F.count("near_miss").alias("beside"), F.count_if(F.col("reason") == "after-cut").alias("after_cut"))


