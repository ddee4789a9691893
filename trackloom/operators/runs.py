"""Run-log rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def rollup(df: DataFrame, keys: list[str], sums: dict[str, Column], labels: Column | None = None) -> DataFrame:
    """Counts, sums and the set of labels per configuration."""
    aggs = [F.count("*").alias("runs"), *[F.sum(c).alias(n) for n, c in sums.items()]]
    if labels is not None:
        aggs.append(F.array_join(F.sort_array(F.collect_set(labels)), ",").alias("labels"))
    return df.groupBy(*keys).agg(*aggs)


def cost_per_minute(df: DataFrame, keys: list[str], cost: str, minutes: str, reused: str) -> DataFrame:
    """Cost of a source minute over rows that weren't reused; null if there are none."""
    fresh = ~F.col(reused)
    return df.groupBy(*keys).agg((F.sum(F.when(fresh, F.col(cost))) / F.nullif(F.sum(F.when(fresh, F.col(minutes))), F.lit(0.0))).alias("cost"), F.count_if(reused).alias("reused"))


def by_week(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Per Monday, for groups of at least two weeks."""
    weeks = df.groupBy(*keys, F.to_date(F.date_trunc("week", F.col(at))).alias("week")).agg(F.count("*").alias("runs"), F.sum(value).alias("total"))
    return weeks.withColumn("_n", F.count("*").over(W.partitionBy(*keys))).where("_n >= 2").drop("_n")


def later_success(df: DataFrame, key: list[str], at: str, failed: Column) -> DataFrame:
    """Each failure with the earliest later success of the same key."""
    # over the order turned round a frame that grows is one step a row; rows of the same time are peers and don't count
    ahead = W.partitionBy(*key).orderBy(F.desc(at)).rangeBetween(W.unboundedPreceding, -1)
    return df.withColumn("recovered_at", F.min(F.when(~failed, F.col(at))).over(ahead)).where(failed)


def merged_counts(df: DataFrame, keys: list[str], numbers: list[str], lists: list[str], flags: list[str], maps: list[str]) -> DataFrame:
    """Result rows added together (A24): numbers add, lists concatenate, flags are or-ed, maps of numbers add key by key."""
    base = df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in numbers], *[F.flatten(F.collect_list(c)).alias(c) for c in lists], *[F.bool_or(c).alias(c) for c in flags])
    for m in maps:
        each = df.select(*keys, F.explode(m).alias("_k", "_v")).groupBy(*keys, "_k").agg(F.sum("_v").alias("_v"))
        base = base.join(each.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_k", "_v")))).alias(m)), keys, "left")
    return base


def reused(detection_seconds: Column, minutes: Column, least: float = 1.0) -> Column:
    """Whether a run's detections came from a cache: less than `least` seconds a source minute."""
    return F.coalesce((minutes > 0) & (F.coalesce(detection_seconds, F.lit(0.0)) / minutes < least), F.lit(False))
