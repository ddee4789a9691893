"""The live path as Structured Streaming: change detection, newest-only consumption, expiry, delayed join, windows.

Late rows beyond the watermark are dropped; that is this engine's own rule.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F


def changed(stream: DataFrame, key: str, at: str, content: str, delay: str = "10 seconds", quiet_ms: int = 60_000) -> DataFrame:
    """Rows whose content differs from the newest row of their key, older rows being skipped (T2, T3); state goes after a quiet time (T4, T5)."""
    kind = stream.schema[key].dataType.simpleString()

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        newest, last = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values(at, kind="stable")
        out = []
        for t, c in zip(rows[at], rows[content]):
            if newest is not None and t.value <= newest:
                continue
            if c != last:
                out.append((k[0], t, c))
            newest, last = t.value, c
        state.update((newest, last))
        state.setTimeoutTimestamp(max(newest // 1_000_000, state.getCurrentWatermarkMs()) + quiet_ms)
        yield pd.DataFrame(out, columns=[key, at, content])

    return stream.withWatermark(at, delay).select(key, at, content).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {at} timestamp, {content} string", "newest long, last string", "append", "EventTimeTimeout")


def delayed(frames: DataFrame, boxes: DataFrame, key: str, delay: str) -> DataFrame:
    """Frames with the boxes of the same key seen at most `delay` before."""
    f = frames.withWatermark("frame_at", delay)
    b = boxes.withWatermark("box_at", delay).withColumnRenamed(key, "_k")
    return f.join(b, F.expr(f"{key} = _k AND box_at <= frame_at AND box_at >= frame_at - INTERVAL {delay}"), "inner").drop("_k")


def digested(stream: DataFrame, content: str) -> DataFrame:
    """content as its size, checksum and MD5, for large contents whose change is looked for: the cheap parts differ first."""
    c = F.col(content).cast("binary")
    return stream.withColumn(content, F.concat_ws(":", F.octet_length(c).cast("string"), F.crc32(c).cast("string"), F.md5(c)))


def unexpired(boxes: DataFrame, now: str, stop: str, delay: float) -> DataFrame:
    """Boxes that aren't over by more than the delay (T4)."""
    return boxes.where(F.col(stop) >= F.col(now) - delay)


def trimmed(frames: DataFrame, keys: list[str], at: str, now: float, keep: float) -> DataFrame:
    """Frames of the last `keep` seconds, and of each key at least the newest (T5)."""
    newest = F.max(at).over(W.partitionBy(*keys))
    return frames.withColumn("_n", newest).where((F.col(at) >= now - keep) | (F.col(at) == F.col("_n"))).drop("_n")


def windowed(stream: DataFrame, keys: list[str], at: str, window: str, delay: str, slide: str | None = None) -> DataFrame:
    """Counts per key and tumbling window, or sliding one."""
    w = F.window(at, window) if slide is None else F.window(at, window, slide)
    return stream.withWatermark(at, delay).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("window_start"), "n")


def sessions(stream: DataFrame, keys: list[str], at: str, gap: str, delay: str) -> DataFrame:
    """Counts per key and session: rows less than the gap apart (T10, W21 live)."""
    out = stream.withWatermark(at, delay).groupBy(*keys, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of (entity_id, at, label, value); the brackets make the path a pattern, which a file source wants."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    return raw.select(F.col("user_id").alias("entity_id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("label"), "value")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a folder of our own only where none is set and Spark runs in this one process, as in tests."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that the driver and the executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="trackloom-stream-"))
    return sc.getCheckpointDir()


def available_now(stream: DataFrame) -> DataFrame:
    """Run a stream over what is there, as checkpointed micro-batches into a table of the shared folder, and read that."""
    spark = stream.sparkSession
    top = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("checkpointLocation", f"{top}/state").outputMode("append").trigger(availableNow=True).start(f"{top}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{top}/rows")


def slots(boxes: str, most: int = 2000):
    """The first `most` boxes of a record; the rest is dropped."""
    return F.slice(boxes, 1, most)
