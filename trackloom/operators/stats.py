"""Distributions, content measures and rule suggestions. Each percentile rule is its own function; none is approximate."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from . import footage
from .footage import SAME_DURATION, SAME_FLOOR, SAME_LABELLED, SAME_SECONDS, SAME_TIMELINE, TIMELINE_BUCKET


def nearest(f: float):
    """Index round-half-even(f * (n - 1)) (A3)."""
    return lambda n: F.bround(F.lit(f) * (n - 1)).cast("long")


def value_bucket(v: Column) -> Column:
    """A number that never falls as v rises: about 177 buckets for each power of two."""
    up = F.floor(F.log(F.abs(v)) * 256).cast("long") + 400_000
    return F.when(v > 0, up).when(v < 0, -up).otherwise(F.lit(0))


def at_ranks(df: DataFrame, keys: list[str], value: str, wanted: dict) -> DataFrame:
    """keys, n, least, most, mean and for each name the value at an index (from 0) of the sorted values, exactly; nulls don't count.

    wanted: name -> function of n. Equal values are counted together; buckets of values are added up, and only those that hold a wanted index
    are sorted, so no group has to fit in one task, and df is computed once.
    """
    v = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    counts = v.groupBy(*keys, value_bucket(F.col("_v")).alias("_bucket"), "_v").agg(F.count("*").alias("_c"))
    buckets = counts.groupBy(*keys, "_bucket").agg(F.sum("_c").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum(F.col("_v") * F.col("_c")).alias("_s"))
    whole = W.partitionBy(*keys)
    buckets = buckets.select(*keys, "_bucket", "_c", (F.sum("_c").over(whole.orderBy("_bucket")) - F.col("_c")).alias("_base"), F.sum("_c").over(whole).alias("n"), F.min("_lo").over(whole).alias("least"), F.max("_hi").over(whole).alias("most"), F.sum("_s").over(whole).alias("_s"))
    asked = F.array(*[F.struct(F.lit(name).alias("name"), index(F.col("n")).cast("long").alias("i")) for name, index in wanted.items()])
    held = F.filter(asked, lambda x: (x["i"] >= F.col("_base")) & (x["i"] < F.col("_base") + F.col("_c")))
    few = buckets.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_bucket").alias("_bucket2"), "_base", "n", "least", "most", (F.col("_s") / F.col("n")).alias("mean"), held.alias("_w")).where(F.size("_w") > 0)
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys], F.col("_bucket") == F.col("_bucket2"))
    order = W.partitionBy(*keys, "_bucket").orderBy("_v")
    found = counts.join(few, same).withColumn("_to", F.col("_base") + F.sum("_c").over(order)).withColumn("_w", F.filter("_w", lambda x: (x["i"] >= F.col("_to") - F.col("_c")) & (x["i"] < F.col("_to")))).where(F.size("_w") > 0)
    each = found.select(*keys, "n", "least", "most", "mean", "_v", F.explode("_w.name").alias("_name"))
    return each.groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("n", "least", "most", "mean")], *[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in wanted])


def describe(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, min, p1, p25, median, p75, p99, max, mean (A1), p90 by the floor rule (A2) and the upper median (A5)."""
    want = {f"p{round(100 * f)}": nearest(f) for f in (0.01, 0.25, 0.75, 0.99)}
    want |= {"p90_floor": lambda n: F.least(n - 1, F.floor(n * 0.9)), "upper_median": lambda n: F.floor(n / 2), "_lo": lambda n: F.floor((n - 1) / 2)}
    s = at_ranks(df, keys, value, want)
    return s.select(*keys, "n", F.col("least").alias("min_v"), F.col("most").alias("max_v"), F.col("mean").alias("mean_v"), ((F.col("_lo") + F.col("upper_median")) / 2).alias("median_v"), *[c for c in want if c != "_lo"])


def percentiles(df: DataFrame, keys: list[str], value: str, at: tuple[float, ...]) -> DataFrame:
    """Linear between ranks (A4)."""
    return df.groupBy(*keys).agg(*[F.percentile(value, f).alias(f"q{round(100 * f)}") for f in at])


def histogram(df: DataFrame, keys: list[str], value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts of equal buckets, empty ones too; the last takes hi and the first what is below lo."""
    b = F.least(F.greatest(F.floor((F.col(value) - lo) / ((hi - lo) / bins)), F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = df.groupBy(*keys, b.alias("bucket")).agg(F.count("*").alias("n"))
    every = counts.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bucket"))
    return every.join(counts, [*keys, "bucket"], "left").fillna(0, ["n"])


def below_share(df: DataFrame, keys: list[str], value: str, least: float) -> DataFrame:
    """Share strictly below a threshold."""
    return df.groupBy(*keys).agg(F.avg(F.when(F.col(value) < least, 1.0).otherwise(0.0)).alias("below"))


#: Fixed values of the valley rule: bins, end of the low and start of the high part, least share and count of the high mass.
VALLEY_BINS, VALLEY_LOW, VALLEY_HIGH, VALLEY_SHARE, VALLEY_COUNT = 20, 6, 10, 0.03, 30


def valley(hist: DataFrame, keys: list[str]) -> DataFrame:
    """From IoU counts (keys, bucket, n), all buckets present: the centre of the emptiest bin, the later of equals, between the low peak and the high peak; null if the
    high part is too small, the peaks are neighbours or the trough is over half the smaller peak (A8)."""
    h = hist.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "n"))), lambda s: s["n"]).alias("h"))  # one array of VALLEY_BINS a key
    low, high = f"slice(h, 1, {VALLEY_LOW})", f"slice(h, {VALLEY_HIGH + 1}, {VALLEY_BINS - VALLEY_HIGH})"
    s = h.selectExpr(*keys, "h", f"array_position({low}, array_max({low})) AS lo_at", f"{VALLEY_HIGH} + array_position({high}, array_max({high})) AS hi_at", f"aggregate({high}, 0L, (a, x) -> a + x) AS mass", "aggregate(h, 0L, (a, x) -> a + x) AS total", f"least(array_max({low}), array_max({high})) AS peak")
    s = s.withColumn("mid", F.expr("slice(h, cast(lo_at + 1 as int), cast(greatest(hi_at - lo_at - 1, 0) as int))")).withColumn("trough", F.array_min("mid"))
    at = F.expr("lo_at + size(mid) - array_position(reverse(mid), trough)")  # from 0
    ok = (F.col("mass") >= F.greatest(F.lit(float(VALLEY_COUNT)), F.col("total") * VALLEY_SHARE)) & (F.size("mid") > 0) & (F.col("trough") * 2 <= F.col("peak"))
    return s.select(*keys, F.when(ok, F.bround((at + 0.5) / VALLEY_BINS, 3)).alias("valley"))


def label_seconds(df: DataFrame, rate: float, least: float = 0.5) -> DataFrame:
    """Seconds in which a label is seen, a sample counting once, one decimal."""
    return df.where(F.col("score") >= least).groupBy("entity_id", "class_id").agg(F.bround(F.countDistinct(F.bround(F.col("t") * rate)) / rate, 1).alias("seconds"))


def pair_seconds(df: DataFrame, rate: float, least: float = 0.5) -> DataFrame:
    """Seconds in which two labels are seen together, per unordered pair."""
    sets = df.where(F.col("score") >= least).groupBy("entity_id", F.bround(F.col("t") * rate).alias("i")).agg(F.sort_array(F.collect_set("class_id")).alias("s"))
    pairs = sets.select("entity_id", "i", F.explode("s").alias("a"), "s").select("entity_id", "a", F.explode("s").alias("b")).where("a < b")
    return pairs.groupBy("entity_id", "a", "b").agg(F.bround(F.count("*") / rate, 1).alias("seconds"))


def mixed_seconds(df: DataFrame, rate: float, least: float = 0.5) -> DataFrame:
    """Seconds of an entity in which two or more labels are seen together, one decimal."""
    n = df.where(F.col("score") >= least).groupBy("entity_id", F.bround(F.col("t") * rate).alias("i")).agg(F.countDistinct("class_id").alias("n"))
    return n.groupBy("entity_id").agg(F.bround(F.count_if(F.col("n") >= 2) / rate, 1).alias("mixed"))


def box_timeline(df: DataFrame, rate: float, labels: list[str] | None = None, least: float = 0.5, bucket: float = 10.0) -> DataFrame:
    """Mean confident boxes of the labels a sample in each bucket of sample indexes, dense from 0 to the last one, three decimals."""
    d = df.where(F.col("score") >= least)
    d = d if labels is None else d.where(F.col("class_id").isin(*labels))
    counts = d.groupBy("entity_id", F.floor(F.bround(F.col("t") * rate) / (rate * bucket)).alias("bucket")).agg(F.count("*").alias("n"))
    every = counts.groupBy("entity_id").agg(F.max("bucket").alias("last")).select("entity_id", F.explode(F.expr("sequence(0, last)")).alias("bucket"))
    return every.join(counts, ["entity_id", "bucket"], "left").select("entity_id", "bucket", F.bround(F.coalesce("n", F.lit(0)) / (bucket * rate), 3).alias("boxes"))


def content_signature(df: DataFrame, durations: DataFrame, rate: float, labels: list[str]) -> DataFrame:
    """entity_id, duration, seconds (map of every label), mixed and timeline; entities of unknown duration are left out."""
    d = df.where(F.col("class_id").isin(*labels))
    per = label_seconds(d, rate).groupBy("entity_id").agg(F.map_from_entries(F.collect_list(F.struct("class_id", "seconds"))).alias("_s"))  # one entry a label
    line = box_timeline(d, rate, labels).groupBy("entity_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "boxes"))), lambda x: x["boxes"]).alias("timeline"))
    zero = F.create_map(*[x for n in sorted(labels) for x in (F.lit(n), F.lit(0.0))])
    seconds = F.transform_values(zero, lambda k, v: F.coalesce(F.try_element_at("_s", k), v))
    out = durations.where("duration > 0").join(per, "entity_id", "left").join(mixed_seconds(d, rate), "entity_id", "left").join(line, "entity_id", "left")
    return out.select("entity_id", "duration", seconds.alias("seconds"), F.coalesce("mixed", F.lit(0.0)).alias("mixed"), F.coalesce("timeline", F.array().cast("array<double>")).alias("timeline"))


def shifted_distance(a: Column, b: Column, shifts: Column) -> Column:
    """Least share of boxes in which two timelines differ where they overlap, over shifts up to `shifts` either way; null if no shift has boxes."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda p, q: p + q)

    def one(k):
        n = F.least(F.size(a) - F.greatest(-k, F.lit(0)), F.size(b) - F.greatest(k, F.lit(0)))
        x = F.slice(a, F.greatest(-k, F.lit(0)) + 1, F.greatest(n, F.lit(0)))
        y = F.slice(b, F.greatest(k, F.lit(0)) + 1, F.greatest(n, F.lit(0)))
        apart = total(F.zip_with(x, y, lambda p, q: F.abs(p - q)))
        return F.when((n > 0) & (F.greatest(total(x), total(y)) > 0), F.try_divide(apart, F.greatest(total(x), total(y))))

    return F.array_min(F.transform(F.sequence(-shifts, shifts), one))


#: A part of a duration bucket: about so many signatures, and so many values of their timelines, at most.
PART_ROWS, PART_VALUES = 8192, 2_000_000


def shown_seconds(seconds: Column) -> Column:
    return F.aggregate(F.map_values(seconds), F.lit(0.0), lambda x, y: x + y)


def same_content(a: str, b: str) -> Column:
    """Whether two signatures (columns with these prefixes) are the same footage."""
    c = lambda p, n: F.col(f"{p}{n}")
    close = lambda x, y, share, floor=0.0: F.abs(x - y) <= F.greatest(F.greatest(x, y) * share, F.lit(floor))
    shown = lambda p: shown_seconds(c(p, "seconds"))
    names = F.array_union(F.map_keys(c(a, "seconds")), F.map_keys(c(b, "seconds")))
    of = lambda p, k: F.coalesce(F.try_element_at(c(p, "seconds"), k), F.lit(0.0))
    totals = close(c(a, "duration"), c(b, "duration"), SAME_DURATION) & (shown(a) >= SAME_LABELLED) & (shown(b) >= SAME_LABELLED) & F.forall(names, lambda k: close(of(a, k), of(b, k), SAME_SECONDS, SAME_FLOOR)) & close(c(a, "mixed"), c(b, "mixed"), SAME_SECONDS, SAME_FLOOR)
    shifts = F.ceil(F.greatest(c(a, "duration"), c(b, "duration")) * SAME_DURATION / TIMELINE_BUCKET).cast("int")
    lines = (F.size(c(a, "timeline")) == 0) | (F.size(c(b, "timeline")) == 0) | F.coalesce(shifted_distance(c(a, "timeline"), c(b, "timeline"), shifts) <= SAME_TIMELINE, F.lit(False))
    return totals & lines


def same_footage(signatures: DataFrame, key: str = "entity_id") -> DataFrame:
    """Pairs (a, b), a < b, of signatures of the same footage (J18); further columns of the signatures come along as a_... and b_....

    Durations are dealt to logarithmic buckets and these by a hash to parts of bounded size. Each two parts of a bucket, or of a bucket and
    the next one, meet in one task, which compares them as arrays.
    """
    # a hair wider than the rule, so that rounding can't put two close durations two buckets apart
    k = F.floor(F.log("duration") / (F.log(F.lit(1 / (1 - SAME_DURATION))) * (1 + 1e-9)))
    rest = [c for c in signatures.columns if c not in (key, "duration", "seconds", "mixed", "timeline")]
    rows = signatures.where(shown_seconds(F.col("seconds")) >= SAME_LABELLED).select(F.col(key).alias("_key"), "duration", "seconds", "mixed", "timeline", *[F.col(c).alias(f"_with_{c}") for c in rest], k.alias("_k"))
    parts = F.ceil(F.greatest(F.count("*") / PART_ROWS, F.sum(F.size("timeline") + F.size("seconds")) / PART_VALUES)).cast("int")
    sizes = rows.groupBy("_k").agg(parts.alias("_parts"))
    each = F.array(*[F.struct((F.col("_k") - d).alias("_k"), *[F.when(F.lit(e == d), F.col("_parts")).alias(n) for e, n in ((0, "_parts"), (1, "_above"), (-1, "_below"))]) for d in (0, 1, -1)])
    sizes = sizes.select(F.explode(each).alias("_each")).select("_each.*").groupBy("_k").agg(*[F.max(n).alias(n) for n in ("_parts", "_above", "_below")])
    dealt = rows.join(sizes, "_k").withColumn("_me", F.pmod(F.xxhash64("_key"), "_parts").cast("int"))
    me = F.col("_me")

    def meet(k, after, i, j, right):
        return F.struct(k.alias("_of"), F.lit(after).alias("_after"), i.alias("_i"), j.alias("_j"), right.alias("_right"))

    up_to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = F.transform(up_to("_parts"), lambda p: meet(F.col("_k"), False, F.least(me, p), F.greatest(me, p), p < me))
    above = F.transform(up_to("_above"), lambda p: meet(F.col("_k"), True, me, p, F.lit(False)))
    below = F.transform(up_to("_below"), lambda p: meet(F.col("_k") - 1, True, p, me, F.lit(True)))
    met = F.concat(own, F.coalesce(above, F.slice(own, 1, 0)), F.coalesce(below, F.slice(own, 1, 0)))
    columns = ["_key", *[f"_with_{c}" for c in rest]]
    tasks = dealt.select(*columns, "duration", "seconds", "mixed", "timeline", F.explode(met).alias("_met")).select("*", "_met.*").drop("_met")
    schema = T.StructType([T.StructField(f"{p}{c}", tasks.schema[c].dataType) for p in ("a_", "b_") for c in columns])

    def run(task: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, after, i, j = (x.as_py() for x in task)
        yield from footage.pairs(pa.Table.from_batches(list(batches)), not after and i == j, columns)

    found = tasks.groupBy("_of", "_after", "_i", "_j").applyInArrow(run, schema)
    sides = lambda x, y: F.struct(*[F.col(f"{p}{c}").alias(f"{q}{c}") for p, q in ((x, "a_"), (y, "b_")) for c in columns])
    pairs = found.where("a__key != b__key").select(F.when(F.col("a__key") < F.col("b__key"), sides("a_", "b_")).otherwise(sides("b_", "a_")).alias("p")).select("p.*")
    return pairs.select(F.col("a__key").alias("a"), F.col("b__key").alias("b"), *[F.col(f"{p}_with_{c}").alias(f"{p}{c}") for p in ("a_", "b_") for c in rest])


def footage_copies(signatures: DataFrame, key: str = "entity_id") -> DataFrame:
    """Each signature's key and copies, the others of the same footage (J18). Equal signatures are one class: only classes are paired, and counted by their members."""
    cols = ["duration", "seconds", "mixed", "timeline"]
    by = signatures.select(F.col(key), F.struct("duration", F.sort_array(F.map_entries("seconds")).alias("seconds"), "mixed", "timeline").alias("_of"))
    classes = by.groupBy("_of").agg(F.count("*").alias("_n"), F.min(key).alias("_k"))
    wide = classes.select("_k", "_n", "_of.duration", F.map_from_entries("_of.seconds").alias("seconds"), "_of.mixed", "_of.timeline")
    pairs = same_footage(wide, "_k")
    each = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("_k"), F.col("b__n").alias("_o")), F.struct(F.col("b").alias("_k"), F.col("a__n").alias("_o")))).alias("p")).select("p.*")
    others = each.groupBy("_k").agg(F.sum("_o").alias("_others"))
    both = classes.select("_of", "_k", "_n", *[(F.map_from_entries("_of.seconds") if x == "seconds" else F.col(f"_of.{x}")).alias(f"{p}{x}") for p in ("a_", "b_") for x in cols])
    own = both.select("_of", "_k", F.when((F.col("_n") > 1) & same_content("a_", "b_"), F.col("_n") - 1).otherwise(0).alias("_own"))
    counts = own.join(others, "_k", "left").select("_of", (F.col("_own") + F.coalesce("_others", F.lit(0))).alias("copies"))
    return by.join(counts, "_of").select(key, "copies")
