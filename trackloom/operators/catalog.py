"""Catalog of cached runs: keys, newest and complete sets, configurations. Each is a window or an aggregate over file rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def settings_key(settings: Column, n: int = 6) -> Column:
    """First n hex digits of the MD5 of a struct or map of settings as JSON; the struct's fields are in order of name."""
    return F.left(F.md5(F.to_json(settings)), F.lit(n))


def content_key(content: Column, n: int = 16) -> Column:
    """Last n hex digits of the MD5 of the content."""
    return F.right(F.md5(content), F.lit(n))


def newest(df: DataFrame, group: list[str], version: list[str]) -> DataFrame:
    """The newest row of each group."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*group).orderBy(*[F.desc(v) for v in version]))).where("_r = 1").drop("_r")


def complete_sets(df: DataFrame, entity: str, run: str, part: str, needed: int, version: str) -> DataFrame:
    """Of each entity the newest run that has all its parts."""
    runs = df.groupBy(entity, run).agg(F.countDistinct(part).alias("_n"), F.max(version).alias("newest")).where(F.col("_n") >= needed).drop("_n")
    return newest(runs, [entity], ["newest", run])


def configurations(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Files grouped to configurations, with the set of a value."""
    return df.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set(F.col(value).cast("string"))), ",").alias("parts"), F.count("*").alias("files"))


def with_fallback(wanted: DataFrame, first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """value from the first table that has the key, else the second."""
    a, b = first.select(key, F.col(value).alias("_a")), second.select(key, F.col(value).alias("_b"))
    return wanted.join(a, key, "left").join(b, key, "left").select(key, F.coalesce("_a", "_b").alias(value))


def first_of_folder(df: DataFrame, folder: str, order: list[str], n: int) -> DataFrame:
    """First n rows of each folder."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(folder).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def slices(df: DataFrame, duration: str, k: int, seconds: float) -> DataFrame:
    """Starts of k slices of some seconds, evenly spread over the room that is left, none at 0, one decimal; 0 for what is too short."""
    room = F.col(duration) - seconds
    spread = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.bround(room * i / (k + 1), 1)))
    return df.withColumn("slice_start", F.explode(F.when(F.coalesce(room > 0, F.lit(False)), spread).otherwise(F.array(F.lit(0.0)))))


def near_duplicates(df: DataFrame, key: str, duration: str, measures: list[str], band: float = 0.02, tolerance: float = 0.06, floor: float = 2.0) -> DataFrame:
    """Pairs whose durations differ by at most a share of the longer one and whose measures differ by at most a share of the larger, or the floor (J18 without timelines).

    Durations are dealt to logarithmic buckets, so it is an equi-join."""
    b = df.where(F.col(duration) > 0).withColumn("_k", F.floor(F.log(F.col(duration)) / F.log(F.lit(1 / (1 - band)))))
    left = b.select(*[F.col(c).alias(f"a_{c}") for c in (key, duration, *measures)], F.explode(F.array(*[F.col("_k") + d for d in (-1, 0, 1)])).alias("_k"))
    pairs = left.join(b.select(*[F.col(c).alias(f"b_{c}") for c in (key, duration, *measures)], "_k"), "_k")
    apart = lambda c: F.abs(F.col(f"a_{c}") - F.col(f"b_{c}"))
    most = lambda c: F.greatest(F.col(f"a_{c}"), F.col(f"b_{c}"))
    cond = (F.col(f"a_{key}") < F.col(f"b_{key}")) & (apart(duration) <= most(duration) * band)
    for m in measures:
        cond = cond & (apart(m) <= F.greatest(most(m) * tolerance, F.lit(floor)))
    return pairs.where(cond).select(f"a_{key}", f"b_{key}")


def all_caches(files: DataFrame, backends: list[str], version: int, floor: float, previews: bool = False) -> DataFrame:
    """Rows of these backends, this version and this score floor (within 0.0005), real runs unless previews are asked for."""
    ok = F.col("backend").isin(*backends) & (F.col("version") == version) & (F.abs(F.col("floor") - floor) <= 5e-4)
    return files.where(ok if previews else ok & (F.coalesce("preview", F.lit("")) == ""))


def merged_configurations(files: DataFrame) -> DataFrame:
    """Files as configurations, one for each backend, sizes and variant, real or preview; without a variant each key stays apart.

    files: backend, sizes, variant, key, preview, entity_id, rate. Several previews of a configuration are named -preview*.
    """
    real = F.coalesce("preview", F.lit("")) == ""
    known = F.coalesce("variant", F.lit("")) != ""
    d = files.select("*", F.when(known, F.concat(F.lit("v:"), "variant")).otherwise(F.concat(F.lit("k:"), F.coalesce("key", F.lit("")))).alias("identity"), (~real).alias("is_preview"))
    g = d.groupBy("backend", "sizes", "identity", "is_preview").agg(F.array_join(F.sort_array(F.collect_set("key")), ",").alias("keys"), F.countDistinct("entity_id").alias("entities"), F.array_join(F.sort_array(F.collect_set(F.col("rate").cast("string"))), ",").alias("rates"), F.min("preview").alias("_lo"), F.max("preview").alias("_hi"))
    return g.withColumn("preview", F.when(~F.col("is_preview"), "").when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise("-preview*")).drop("_lo", "_hi", "is_preview")


def cut_cache(scans: DataFrame, key: str = "entity_id") -> DataFrame:
    """Of each entity's cut scans the best: a whole-file one (most_seconds null) first, then the newest."""
    order = W.partitionBy(key).orderBy(F.col("most_seconds").isNull().desc(), F.desc("written"), "path")
    return scans.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def removable(rounds: DataFrame, now: float, stale_days: float = 14.0, aborted_seconds: float = 3600.0) -> DataFrame:
    """Rounds whose renders may go, with category and bytes; records stay, and nothing is deleted here.

    rounds: name, decided, ranked, recorded (any other record), renders, bytes (of renders), files_bytes, changed (seconds).
    """
    age = F.lit(now) - F.col("changed")
    kind = F.when(F.col("decided"), F.when(F.col("renders") > 0, "decided_renders")).when(F.col("ranked"), F.when((F.col("renders") > 0) & (age >= stale_days * 86400), "stale_renders")).when((F.col("renders") == 0) & ~F.col("recorded") & (age >= aborted_seconds), "aborted_rounds")
    return rounds.withColumn("category", kind).where("category is not null").select("name", "category", F.when(F.col("category") == "aborted_rounds", F.col("files_bytes")).otherwise(F.col("bytes")).alias("bytes"))


def resume_points(samples: DataFrame, checkpoints: DataFrame, key: str = "entity_id") -> DataFrame:
    """Samples a scan still has to take: those from its checkpoint's next sample on, all without a checkpoint (S11). checkpoints: key, next_sample; null ones are corrupt and don't count."""
    c = checkpoints.where("next_sample is not null").groupBy(key).agg(F.max("next_sample").alias("_next"))
    return samples.join(c, key, "left").where(F.col("i") >= F.coalesce("_next", F.lit(0))).drop("_next")
