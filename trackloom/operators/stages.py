"""Same-instant stages over detections: de-duplication, promotion, geometry, relevance, suppression, entry gate.

All pair rows of one entity and instant only; the key is (entity_id, sample_index). Groups are a handful of rows, so each is
gathered to an array, once, and rows are judged against the others of their array: one shuffle, no self-join and no join back.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.boxes import iou, iou_of, share_of

INSTANT = ["entity_id", "sample_index"]
BOX = ["x", "y", "w", "h"]


def rules_frame(spark: SparkSession, rules: list[tuple], schema: str) -> DataFrame:
    """Rules are a list in the program, so their size is known and they may be broadcast."""
    return F.broadcast(spark.createDataFrame(rules, schema))


def gathered(df: DataFrame, keys: list[str] = INSTANT, order: list | None = None) -> DataFrame:
    """keys, all (the group's rows as structs; in order of `order`, which comes first in the structs, if given)."""
    rest = [F.col(c) for c in df.columns if c not in keys]
    rows = F.collect_list(F.struct(*(order or []), *rest))
    return df.groupBy(*keys).agg((F.sort_array(rows) if order else rows).alias("all"))


def judged(df: DataFrame, **found) -> DataFrame:
    """df with columns found: functions of a row and the array of its instant's rows."""
    one = gathered(df).select(*INSTANT, F.explode("all").alias("r"), "all")
    return one.select(*[F.col(c) if c in INSTANT else F.col(f"r.`{c}`") for c in df.columns], *[f(F.col("r"), F.col("all")).alias(n) for n, f in found.items()])


def same_instant_pairs(df: DataFrame) -> DataFrame:
    """Ordered pairs (a_*, b_*) of different rows of an instant with their IoU."""
    cols = [*BOX, "class_id", "score", "size", "pos"]
    g = gathered(df.select(*INSTANT, *cols))
    pairs = g.select(*INSTANT, F.explode("all").alias("a"), "all").select(*INSTANT, "a", F.explode("all").alias("b")).where("a.pos <> b.pos")
    return pairs.select(*INSTANT, *[F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in "ab" for c in cols]).withColumn("iou", iou("a_", "b_"))


def suppressed(df: DataFrame, rules: list[tuple[str, str, float, float]], with_iou: bool = False) -> DataFrame:
    """Rows with suppressor pos and rule (null if kept). rules: (loser, winner, least IoU, least margin). A suppressed row still suppresses others.

    with_iou: also the suppressor's label and IoU."""

    def hits(r, rows, k, loser, winner, least, margin):
        found = F.filter(rows, lambda o: (r["class_id"] == loser) & (o["class_id"] == winner) & (o["pos"] != r["pos"]) & (o["score"] - r["score"] >= margin) & (iou_of(r, o) >= least))
        return F.transform(found, lambda o: F.struct(o["pos"].alias("pos"), F.lit(k).alias("rule"), o["class_id"].alias("label"), iou_of(r, o).alias("iou")))

    def by(r, rows):
        return F.array_min(F.concat(*[hits(r, rows, k, *rule) for k, rule in enumerate(rules)]))

    out = judged(df, _by=by).withColumns({"by_pos": F.col("_by.pos"), "rule": F.col("_by.rule")})
    return (out.withColumns({"by_label": F.col("_by.label"), "by_iou": F.col("_by.iou")}) if with_iou else out).drop("_by")


@dataclass(frozen=True)
class Evidence:
    """What a promotion needs at the same instant. Without a threshold any overlap counts; anywhere: no overlap is needed."""

    label: str
    min_prob: float = 0.0
    min_iou: float | None = None
    min_source_overlap: float | None = None
    anywhere: bool = False


@dataclass(frozen=True)
class Promotion:
    """A detection of `source` becomes `target` if its score is enough, no target has the duplicate IoU with it, and any (or all) of the evidence is there."""

    source: str
    target: str
    min_prob: float = 0.0
    duplicate_iou: float = 0.5
    requires: tuple[Evidence, ...] = ()
    need_all: bool = False


def promoted(df: DataFrame, rules: list[Promotion]) -> DataFrame:
    """Rows with outcome, rule (its place in the list) and label after promotion (J3). Evidence is judged by original labels.

    A rule that finds its target already there ends the search, one without evidence leaves it to the next; the outcome is that of the
    last rule looked at, null if no rule judged the row. rule_outcomes has the outcome of every rule looked at.
    """
    def there(r, e: Evidence):
        def ok(o):
            here = (o["class_id"] == e.label) & (o["score"] >= e.min_prob) & (o["pos"] != r["pos"])
            if e.anywhere:
                return here
            if e.min_iou is None and e.min_source_overlap is None:
                return here & (share_of(r, o) > 0)
            if e.min_iou is not None:
                here = here & (iou_of(r, o) >= e.min_iou)
            return here if e.min_source_overlap is None else here & (share_of(r, o) >= e.min_source_overlap)

        return ok

    def outcome(r, rows, k: int, p: Promotion):
        found = [F.exists(rows, there(r, e)) for e in p.requires]
        enough = F.lit(True) if not found else reduce(lambda x, y: x & y if p.need_all else x | y, found)
        taken = F.exists(rows, lambda o: (o["class_id"] == p.target) & (o["pos"] != r["pos"]) & (iou_of(r, o) >= p.duplicate_iou))
        looked = (r["class_id"] == p.source) & (r["score"] >= p.min_prob)
        return F.when(looked, F.struct(F.when(taken, "already_covered").when(enough, "promoted").otherwise("no_evidence").alias("outcome"), F.lit(k).alias("rule"), F.lit(p.target).alias("target")))

    def outcomes(r, rows):
        return F.array(*[outcome(r, rows, k, p) for k, p in enumerate(rules)])

    out = judged(df, _each=outcomes)
    each = F.col("_each")
    some = F.filter(each, lambda x: x.isNotNull())
    # what is looked at ends with the first rule that decides
    upto = F.coalesce(F.nullif(F.array_position(F.transform(some, lambda x: x["outcome"] != "no_evidence"), True), F.lit(0)), F.size(some).cast("long")).cast("int")
    looked = F.when(F.size(some) > 0, F.slice(some, 1, upto))
    out = out.withColumn("rule_outcomes", looked).withColumn("_last", F.element_at("rule_outcomes", -1))
    out = out.withColumns({"outcome": F.col("_last.outcome"), "rule": F.col("_last.rule")}).withColumn("label", F.when(F.col("outcome") == "promoted", F.col("_last.target")).otherwise(F.col("class_id")))
    return out.drop("_last", "_each")


def stage_counts(spark: SparkSession, stages: dict[str, DataFrame]) -> DataFrame:
    """Rows (stage, class_id, n) of the frames that a chain of stages leaves (A25); stages in their order."""
    return reduce(DataFrame.unionByName, [d.groupBy("class_id").agg(F.count("*").alias("n")).withColumn("stage", F.lit(name)) for name, d in stages.items()])


#: Overlap of a kept row k and a row r, of structs.
_SHARED = "(greatest(least(k.x + k.w, r.x + r.w) - greatest(k.x, r.x), 0D) * greatest(least(k.y + k.h, r.y + r.h) - greatest(k.y, r.y), 0D))"


def greedy(df: DataFrame, keys: list[str], falls: str) -> DataFrame:
    """The rows of each group that no row kept before them, by falling score and then pos, makes fall: a condition on structs k (kept) and r. A fold inside the JVM over a group's rows."""
    groups = gathered(df, keys, [(-F.col("score")).alias("_s"), F.col("pos").alias("_p")])
    kept = F.expr(f"aggregate(all, slice(all, 1, 0), (acc, r) -> if(exists(acc, k -> {falls}), acc, concat(acc, array(r))))")
    return groups.select(*keys, F.explode(kept).alias("k")).select(*[F.col(c) if c in keys else F.col(f"k.`{c}`") for c in df.columns])


def cross_size_dedup(df: DataFrame, min_iou: float = 0.6) -> DataFrame:
    """Greedy by score: a row falls to a kept row of the same label and instant and another size (J4). Nothing falls where an entity has one size."""
    return greedy(df, [*INSTANT, "class_id"], f"k.size <> r.size and {_SHARED} > 0 and {_SHARED} >= {min_iou} * (k.w * k.h + r.w * r.h - {_SHARED})")


def cross_size_pairs(df: DataFrame) -> DataFrame:
    """Unordered pairs of one instant and label but different sizes."""
    return same_instant_pairs(df).where("a_pos < b_pos and a_class_id = b_class_id and a_size <> b_size")


def relevant(df: DataFrame, labels: list[str]) -> DataFrame:
    """Rows whose label something uses."""
    return df.where(F.col("class_id").isin(*labels))


def entry_gate(df: DataFrame, settings: list[tuple[str, float, float | None]], time_safety: float) -> DataFrame:
    """settings: (label, min_prob, min_prob_continue or None). Rows over the lower bound, strictly; those not over min_prob are provisional."""
    s = rules_frame(df.sparkSession, settings, "class_id string, min_prob double, cont double")
    out = df.join(s, "class_id").where(F.col("score") > F.least("min_prob", F.coalesce("cont", "min_prob")))
    return out.withColumns({"provisional": F.col("cont").isNotNull() & (F.col("score") <= F.col("min_prob")), "start": F.greatest(F.col("t") - time_safety / 2, F.lit(0.0)), "stop": F.col("t") + time_safety / 2}).drop("min_prob", "cont")
