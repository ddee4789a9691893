"""Mixing sources to target weights by Pfair scheduling.

Each source is a stream of documents in a fixed pseudo-random order, cut into blocks of block_bytes. Weights are exact fractions
w of their sum: block k of a source is released at floor(k/w) and due at ceil((k+1)/w); the earliest deadline among the released
goes first, so after any number of slots each source that still has blocks is less than one block from its share of the given
weights, at any length. The whole schedule is made block by block, holding one block for each source, by one task whose
input is the sizes of the sources; documents are placed by a join and sums.

A source that has run out leaves its later slots empty; the others keep their relative weights. A source of weight zero comes after all
others. Every row gets a slot: nothing is dropped or repeated. A null source is a source of its own; null and empty texts have size 1 (a separator); repeated rows
each get a place; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import ship

def counts_in_period(weights: dict, period: int) -> dict:
    """Whole slots of each source in a period: at least one each, the rest by largest remainder."""
    total = sum(weights.values())
    spare = period - len(weights)
    if spare < 0 or total <= 0 or min(weights.values()) < 0:
        raise ValueError("weights must be positive in sum, and the period at least the number of sources")
    exact = {s: Fraction(w) / Fraction(total) * period for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (out[s] - exact[s], str(s)))
    while (short := period - sum(out.values())) > 0:
        for s in order[:short]:
            out[s] += 1
    while (over := sum(out.values()) - period) > 0:
        for s in [s for s in sorted(exact, key=lambda s: (exact[s] - out[s], str(s))) if out[s] > 1][:over]:
            out[s] -= 1
    return out


def schedule(weights: dict, blocks: dict) -> Iterator[tuple]:
    """(source, block, release, deadline, slot) of each block, earliest deadline first among the released; exact in whole numbers."""
    exact = {s: Fraction(weights[s]) for s in blocks}
    if exact and (sum(exact.values()) <= 0 or min(exact.values()) < 0):
        raise ValueError("weights must be positive in sum")
    unit = math.lcm(*[x.denominator for x in exact.values()])
    part = {s: int(x * unit) for s, x in exact.items()}
    total = sum(part.values())
    window = lambda s, k: (k * total // part[s], -(-(k + 1) * total // part[s]))
    # a source's blocks are released and due in their order, so one of each is enough
    later = [(*window(s, 0), str(s), 0, s) for s, n in blocks.items() if n and part[s]]
    ready: list[tuple] = []
    heapq.heapify(later)
    slot = 0
    while ready or later:
        if not ready:
            slot = max(slot, later[0][0])
        while later and later[0][0] <= slot:
            release, due, name, k, s = heapq.heappop(later)
            heapq.heappush(ready, (due, release, name, k, s))
        due, release, name, k, s = heapq.heappop(ready)
        if slot >= due:
            raise AssertionError("a block missed its deadline")
        yield s, k, release, due, slot
        slot += 1
        if k + 1 < blocks[s]:
            heapq.heappush(later, (*window(s, k + 1), name, k + 1, s))
    for s, n in sorted(blocks.items(), key=lambda x: str(x[0])):
        for k in range(0 if part[s] else n):
            yield s, k, slot, slot + 1, slot
            slot += 1


def pfair(counts: dict) -> list[tuple]:
    """(source, j, release, deadline, slot) of each block of one period of these counts."""
    return list(schedule(counts, counts))


def mix_sources(df: DataFrame, weights: dict | None = None, block_bytes: int = 1 << 18, alpha: float = 0.5, seed: int = 7, text: str = "text", key: str = "doc_id", source: str = "source", keep: tuple[str, ...] = ("doc_id", "source"), bucket_rows: int = 2_000, most_buckets: int = 20_000) -> DataFrame:
    """keep columns plus n_bytes, block, release, deadline, slot and at_byte (the document's start in its source's stream).

    The mix is read in the order (slot, at_byte, doc_id). weights: by source; None takes each source's bytes to the power alpha.
    A source without a weight gets the smallest one given.
    """
    spark = df.sparkSession
    name = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))
    rows = df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], name.alias("_s"), F.col(key).alias("_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("_b"), F.xxhash64(F.lit(seed), F.col(key), F.col(source)).alias("_h"))
    sizes = rows.groupBy("_s").agg(F.sum("_b").alias("b"), F.count("*").alias("n")).collect()  # one row per source
    schema = "_s string, _block long, _release long, _due long, _slot long"
    w = {r["_s"]: float(r["b"]) ** alpha for r in sizes}
    if weights is not None:
        given = {("n" if s is None else f"s{s}"): x for s, x in weights.items()}
        w = {s: given.get(s, min(given.values())) for s in w}
    blocks = {r["_s"]: -(-r["b"] // block_bytes) for r in sizes}
    per_bucket = max(bucket_rows, -(-sum(r["n"] for r in sizes) // most_buckets))
    each = spark.createDataFrame([(r["_s"], -(-r["n"] // per_bucket)) for r in sizes], "_s string, _parts int")
    ship(spark)

    def plan_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            made = schedule(w, blocks)
            while some := list(islice(made, 1 << 14)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), [pa.string()] + [pa.int64()] * 4)], names=["_s", "_block", "_release", "_due", "_slot"])

    plan = spark.range(0, 1, 1, 1).mapInArrow(plan_of, schema)
    # A source's rows are dealt to buckets by a hash, so that a hot source is many; a bucket's first byte is the sum of those before it.
    rows = rows.join(F.broadcast(each), "_s").withColumn("_p", F.pmod(F.shiftright("_h", 8), F.col("_parts").cast("long")))  # each: one row per source
    first = rows.groupBy("_s", "_p").agg(F.sum("_b").alias("_sum"))
    first = first.select("_s", "_p", (F.sum("_sum").over(W.partitionBy("_s").orderBy("_p")) - F.col("_sum")).alias("_base"))
    own = W.partitionBy("_s", "_p").orderBy("_h", "_id", "_b").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_end", F.sum("_b").over(own)).join(first, ["_s", "_p"]).withColumn("_at", F.col("_base") + F.col("_end") - F.col("_b"))
    rows = rows.withColumn("_block", F.floor(F.col("_at") / F.lit(block_bytes)).cast("long"))
    out = rows.drop("_parts").join(plan, ["_s", "_block"])
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], F.col("_b").alias("n_bytes"), F.col("_block").alias("block"), F.col("_release").alias("release"), F.col("_due").alias("deadline"), F.col("_slot").alias("slot"), F.col("_at").alias("at_byte"))
