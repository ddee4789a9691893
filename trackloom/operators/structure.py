"""Shot structure: spans between cuts, signals and profiles. Cuts are nullable arrays: null was never scanned, empty has none."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from . import stats

SHORT = 1.0


def cut_arrays(df: DataFrame, key: str = "entity_id", t: str = "t") -> DataFrame:
    return df.groupBy(key).agg(F.sort_array(F.collect_list(t)).alias("cuts"))


def spans(cuts: Column, seconds: Column) -> Column:
    """Lengths of shots, the opening and closing ones included, positive ones only."""
    ends = F.concat(F.array(F.lit(0.0)), cuts, F.when(seconds.isNotNull(), F.array(seconds)).otherwise(F.array().cast("array<double>")))
    steps = F.zip_with(F.slice(ends, 2, F.greatest(F.size(ends) - 1, F.lit(0))), F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))), lambda b, a: b - a)
    return F.filter(steps, lambda x: x > 0)


def signals(df: DataFrame) -> DataFrame:
    """df (entity_id, cuts, seconds): count, seconds, cuts a minute, duration-weighted share of short shots and median shot; null where an input is."""
    known = F.col("cuts").isNotNull() & F.col("seconds").isNotNull() & (F.col("seconds") > 0)
    s = df.withColumn("_s", F.when(known, spans(F.col("cuts"), F.col("seconds"))))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    short = F.filter("_s", lambda x: x < SHORT)
    n = F.size("_s")
    o = F.sort_array("_s")
    mid = F.when(n > 0, (F.element_at(o, F.floor((n + 1) / 2).cast("int")) + F.element_at(o, F.floor(n / 2).cast("int") + 1)) / 2)
    return s.select("entity_id", F.when(known, F.size("cuts")).cast("long").alias("cut_count"), F.when(known, F.col("seconds")).alias("scanned_seconds"), F.when(known, 60 * F.size("cuts") / F.col("seconds")).alias("cuts_per_min"), F.when(known & (total("_s") > 0), total(short) / total("_s")).alias("short_shot_fraction"), mid.alias("median_shot_seconds"))


@dataclass(frozen=True)
class Profile:
    """threshold None: none given, which counts as 0; manual: never chosen by measurement; fps None: the general rate."""

    name: str
    threshold: float | None = None
    manual: bool = False
    fps: float | None = None


def pick_profile(measured: DataFrame, profiles: list[Profile], default: str | None, signal: str = "cuts_per_min") -> DataFrame:
    """The profile with the highest threshold that the signal clears, the first of equals, manual ones left out; the default, if it isn't manual, where none
    clears it or nothing was measured (R2). profiles is a list in the program."""
    auto = [p for p in profiles if not p.manual]
    fallback = F.lit(default if default in {p.name for p in auto} else None).cast("string")
    pick = fallback
    # the last condition set is asked first: rising thresholds, the first of equals last
    for p in sorted(reversed(auto), key=lambda p: p.threshold or 0.0):
        pick = F.when(F.col(signal) >= (p.threshold or 0.0), p.name).otherwise(pick)
    return measured.withColumn("profile", F.when(F.col(signal).isNull(), fallback).otherwise(pick))


def glob_pattern(glob: str) -> str:
    """A shell pattern as a regular expression for a whole string."""
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


def declared_profile(df: DataFrame, path: str, folder: str, profiles: list[Profile], forced: str | None = None, by_path: list[tuple[str, str]] = (), by_folder: list[tuple[str, str]] = ()) -> DataFrame:
    """df with declared and reason (R1): the forced profile, else that of the first pattern that matches the path or its last part, else that of the deepest folder
    named; null where nothing is declared. folder: the path's folders below the root, joined by /. A name that is no profile declares nothing; forced, it declares null."""
    names = {p.name for p in profiles}
    none = F.lit(None).cast("string")
    if forced:
        return df.withColumns({"declared": F.lit(forced if forced in names else None).cast("string"), "reason": F.lit("forced")})
    base = F.element_at(F.split(path, "/"), -1)
    hits = F.array(*[F.when(F.col(path).rlike(glob_pattern(g)) | base.rlike(glob_pattern(g)), F.lit(n)) for g, n in by_path]) if by_path else F.array().cast("array<string>")
    first = F.try_element_at(F.filter(hits, lambda x: x.isNotNull()), F.lit(1))
    by_pattern = F.when(first.isin(*names), first)
    by_dir = none
    for key, name in sorted(by_folder, key=lambda x: x[0].count("/")):  # the deepest is asked first
        key = key.strip("/")
        if key:
            by_dir = F.when(F.startswith(F.concat(F.col(folder), F.lit("/")), F.lit(key + "/")), F.lit(name if name in names else None).cast("string")).otherwise(by_dir)
    return df.withColumns({"declared": F.coalesce(by_pattern, by_dir), "reason": F.when(by_pattern.isNotNull(), "pattern").when(by_dir.isNotNull(), "folder")})


def sample_rate(profile: Column, profiles: list[Profile], general: float) -> Column:
    """The sample rate of a profile, or the general one."""
    out = F.lit(float(general))
    for p in profiles:
        if p.fps is not None:
            out = F.when(profile == p.name, float(p.fps)).otherwise(out)
    return out


#: Fixed values of the folder recommendation.
SPLIT_BOXES, SPLIT_LEFT, SPLIT_FRAMES, COMPILATION_SHARE = 5, (0.40, 0.60), 30, 0.375


def recommended(df: DataFrame, quick_threshold: float | None, quick: str | None = "quick_cut", limits: tuple = (SPLIT_BOXES, SPLIT_LEFT, SPLIT_FRAMES, COMPILATION_SHARE)) -> DataFrame:
    """df (p90_simultaneous, left_half_fraction, frames_with_boxes, short_shot_fraction, mid_shot_fraction) with recommended, null where never scanned."""
    boxes, (low, high), frames, share = limits
    split = (F.coalesce("p90_simultaneous", F.lit(0)) >= boxes) & F.col("left_half_fraction").between(low, high) & (F.col("frames_with_boxes").isNull() | (F.col("frames_with_boxes") >= frames))
    fast = F.lit(False) if quick_threshold is None or not quick else F.col("short_shot_fraction") >= quick_threshold
    pick = F.when(F.coalesce(split, F.lit(False)), "split_screen").when(F.col("short_shot_fraction").isNull(), None).when(fast, quick).when(F.col("mid_shot_fraction") >= share, "compilation").otherwise("scene")
    return df.withColumn("recommended", pick)


def move_verdict(df: DataFrame, profiles: list[Profile], general: float) -> DataFrame:
    """df (recommended, declared, folder, whole_file) with move: whether a recommended move is made or only listed, and why."""
    to, now = sample_rate(F.col("recommended"), profiles, general), sample_rate(F.col("declared"), profiles, general)
    spatial = F.col("recommended") == "split_screen"
    manual = F.col("declared").isin(*[p.name for p in profiles if p.manual]) if any(p.manual for p in profiles) else F.lit(False)
    why = F.when(~spatial & ~F.col("whole_file"), "slice").when(F.col("declared").isNotNull() & (to < now), "lower rate").when(F.col("declared").isNotNull() & manual & ~spatial & (to <= now), "judgment").when(F.col("declared").isNull() & (F.col("folder") != ""), "unmapped")
    return df.withColumns({"why": why, "move": F.when(F.col("recommended").isNotNull(), F.when(why.isNull(), "script").otherwise("review"))})


def box_structure(df: DataFrame, wide: float, high: float) -> DataFrame:
    """Per entity (A29): boxes, instants with boxes, median and p90 of boxes an instant, share of centres in the left half and median area share."""
    per = df.groupBy("entity_id", F.bround("t", 3).alias("t")).agg(F.count("*").alias("n"))
    r = stats.at_ranks(per, ["entity_id"], "n", {"_lo": lambda n: F.floor((n - 1) / 2), "_hi": lambda n: F.floor(n / 2), "p90": lambda n: F.floor((n - 1) * 0.9)})
    a = stats.at_ranks(df.withColumn("_a", F.col("w") * F.col("h")), ["entity_id"], "_a", {"_lo": lambda n: F.floor((n - 1) / 2), "_hi": lambda n: F.floor(n / 2)})
    area = a.select("entity_id", F.bround((F.col("_lo") + F.col("_hi")) / 2 / (wide * high), 5).alias("median_area_fraction"))
    left = df.groupBy("entity_id").agg(F.count("*").alias("detections"), F.bround(F.count_if(F.col("x") + F.col("w") / 2 < wide / 2) / F.count("*"), 3).alias("left_half_fraction"))
    return left.join(r.select("entity_id", F.col("n").alias("frames_with_boxes"), ((F.col("_lo") + F.col("_hi")) / 2).alias("median_simultaneous"), F.col("p90").cast("long").alias("p90_simultaneous")), "entity_id").join(area, "entity_id")
