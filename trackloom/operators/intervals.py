"""Interval algebra, as gaps and islands over sorted windows, and bucketed range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def islands(df: DataFrame, keys: list[str], start: str = "start", stop: str = "stop", gap: float = 0.0, strict: bool = False) -> DataFrame:
    """Union of intervals per key: those at most gap apart join (W20); with strict, less than gap (W23). keys, start, stop, n."""
    order = W.partitionBy(*keys).orderBy(start, stop)
    before = F.max(stop).over(order.rowsBetween(W.unboundedPreceding, -1))
    apart = F.col(start) - F.col("_before")
    new = F.when(F.col("_before").isNull() | ((apart >= gap) if strict else (apart > gap)), 1).otherwise(0)
    marked = df.withColumn("_before", before).withColumn("_new", new).withColumn("_island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_island").agg(F.min(start).alias("start"), F.max(stop).alias("stop"), F.count("*").alias("n")).drop("_island")


def triggers(df: DataFrame, keys: list[str], lead: float, hold: float, t: str = "t") -> DataFrame:
    """Intervals [max(0, t - lead), t + hold], joined."""
    return islands(df.select(*keys, F.greatest(F.col(t) - lead, F.lit(0.0)).alias("start"), (F.col(t) + hold).alias("stop")), keys)


def bursts(df: DataFrame, key: str, window: float, max_span: float, t: str = "t") -> DataFrame:
    """Runs of cuts with gaps below window (less 1e-6): key, first, last, n and whether the run is short enough to be one burst."""
    order = W.partitionBy(key).orderBy(t)
    marked = df.withColumn("_g", F.col(t) - F.lag(t).over(order)).withColumn("_b", F.sum(F.when(F.col("_g") < window - 1e-6, 0).otherwise(1)).over(order))
    runs = marked.groupBy(key, "_b").agg(F.min(t).alias("first"), F.max(t).alias("last"), F.count("*").alias("n")).drop("_b")
    return runs.withColumn("burst", (F.col("n") > 1) & (F.col("last") - F.col("first") <= max_span + 1e-6))


def range_join(points: DataFrame, spans: DataFrame, keys: list[str], t: str, start: str, stop: str, bucket: float, how: str = "inner", extra: Column | None = None) -> DataFrame:
    """Points and the spans that hold them, ends included. Spans are dealt to time buckets, so it is an equi-join, not a product.

    how: inner, left_semi or left_anti.
    """
    p = points.withColumn("_k", F.floor(F.col(t) / bucket))
    s = spans.withColumn("_k", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(stop) / bucket))))
    on = [p[k] == s[k] for k in (*keys, "_k")]
    cond = (p[t] >= s[start]) & (p[t] <= s[stop])
    for c in on:
        cond = cond & c
    if extra is not None:
        cond = cond & extra
    joined = p.join(s, cond, how)
    return joined.drop("_k") if how != "inner" else joined.select(*[p[c] for c in points.columns], *[s[c] for c in spans.columns if c not in keys])


def opacity(samples: DataFrame, spans: DataFrame, keys: list[str], fade: float, t: str = "t") -> DataFrame:
    """1 inside a span, fading linearly before the next and after the last one, the larger of both."""
    cols = [*keys, F.col(t)]
    both = samples.select(*cols, F.lit(None).cast("double").alias("_s"), F.lit(None).cast("double").alias("_e"), F.lit(1).alias("_o"))
    both = both.unionByName(spans.select(*keys, F.col("start").alias(t), F.col("start").alias("_s"), F.col("stop").alias("_e"), F.lit(0).alias("_o")))
    past = W.partitionBy(*keys).orderBy(t, "_o").rowsBetween(W.unboundedPreceding, 0)
    # the next span by the same kind of frame over the order turned round: a frame that grows is one step a row
    ahead = W.partitionBy(*keys).orderBy(F.desc(t), F.desc("_o")).rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumn("_stop", F.last("_e", True).over(past)).withColumn("_next", F.last("_s", True).over(ahead)).where("_o = 1")
    after = F.when(F.col(t) <= F.col("_stop"), 1.0).otherwise(F.greatest(1 - (F.col(t) - F.col("_stop")) / fade, F.lit(0.0)))
    before = F.greatest(1 - (F.col("_next") - F.col(t)) / fade, F.lit(0.0))
    return both.select(*keys, t, F.greatest(F.coalesce(after, F.lit(0.0)), F.coalesce(before, F.lit(0.0))).alias("opacity"))
