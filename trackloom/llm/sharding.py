"""Sharding by histogram sort.

Rows are sorted by (hash of the text, doc_id), so equal texts are neighbours. Splitters are found by counting, exactly and in
parallel, the bytes and rows below candidate boundaries: a round's candidates are the 256 children of each key prefix that
still holds a wanted splitter too coarsely or too many rows for one task. Rounds end when each shard boundary meets the
tolerance; then the rows are exchanged once, by range, and numbered.

A boundary moves to the edge of a group of equal texts if that costs at most group_tolerance of a shard; a larger group is
split by doc_id. Null texts have no bytes (size 1) and sort as equal to empty ones; a null doc_id sorts first; rows that
repeat in both text and doc_id stay together; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import checkpointed, map_batches

BITS, DEPTHS = 8, 16  # 128 bits of key: 64 of the text's hash, 64 of doc_id
#: Once the open prefixes hold no more rows than this, one round reads their keys instead of descending further.
FEW = 20_000
ALL = 2**64 - 1


def _prefix(depth: int):
    """The first depth bytes of the key, as (hash prefix, doc prefix)."""
    h = F.shiftrightunsigned("_h", 64 - BITS * min(depth, 8)) if depth else F.lit(0).cast("long")
    d = F.shiftrightunsigned("_d", 64 - BITS * (depth - 8)) if depth > 8 else F.lit(0).cast("long")
    return h, d


def _low(depth: int, prefix: tuple[int, int]) -> tuple[int, int]:
    """The smallest key with this prefix."""
    h, d = (x & ALL for x in prefix)
    return (h << (64 - BITS * min(depth, 8)) if depth < 8 else h) & ALL, (d << (64 - BITS * (depth - 8))) & ALL if depth > 8 else 0


def splitters(slim: DataFrame, n_shards: int, tolerance: float, group_tolerance: float, parts: int) -> tuple[list, list[int], list[int]]:
    """Cells in key order as (low key, bytes, rows), the index of each shard's first cell, and of each task's first cell.

    slim has _h, _d (unsigned keys as longs) and _b. The cells on the driver are bounded by the shards and tasks, not by the rows.
    """
    spark = slim.sparkSession
    total, n = slim.agg(F.coalesce(F.sum("_b"), F.lit(0)), F.count("*")).first()
    done: list[tuple[tuple[int, int], int, int]] = []
    open_cells = {(0, 0)}
    below = {(0, 0): 0}  # bytes before each open prefix
    most_rows, share = max(1, -(-n // parts)), total / n_shards
    wanted = [round(share * k) for k in range(1, n_shards)]
    in_open = n
    for depth in range(1, DEPTHS + 1):
        if not open_cells or not n:
            break
        (ph, pd), (qh, qd) = _prefix(depth - 1), _prefix(depth)
        last = in_open <= FEW
        rows = slim.withColumns({"_ph": ph, "_pd": pd, "_qh": F.col("_h") if last else qh, "_qd": F.col("_d") if last else qd})
        if depth > 1:
            rows = rows.join(F.broadcast(spark.createDataFrame([(_signed(a), _signed(b)) for a, b in open_cells], "_ph long, _pd long")), ["_ph", "_pd"], "left_semi")
        counted: dict[tuple[int, int], list] = {}
        for r in rows.groupBy("_ph", "_pd", "_qh", "_qd").agg(F.sum("_b").alias("b"), F.count("*").alias("n")).collect():
            counted.setdefault((r["_ph"] & ALL, r["_pd"] & ALL), []).append(((r["_qh"] & ALL, r["_qd"] & ALL), r["b"], r["n"]))
        next_open, next_below, in_open = set(), {}, 0
        for cell, children in counted.items():
            at = below[cell]
            children.sort()
            if last:
                children = whole_groups(children, group_tolerance * share)
            for q, b, rows_in in children:
                k = bisect_left(wanted, at + 1)
                coarse = k < len(wanted) and at < wanted[k] < at + b and b > (group_tolerance if depth >= 8 else tolerance) * share
                if not last and depth < DEPTHS and rows_in > 1 and (coarse or rows_in > most_rows):
                    next_open.add(q)
                    next_below[q] = at
                    in_open += rows_in
                else:
                    done.append((q if last else _low(depth, q), b, rows_in))
                at += b
        open_cells, below = next_open, next_below
    done.sort()
    starts, at, k = [0], 0, 0
    edges = []
    for _, b, _ in done:
        edges.append(at)
        at += b
    for x in wanted:
        k = bisect_left(edges, x)
        if k and (k == len(edges) or x - edges[k - 1] < edges[k] - x):
            k -= 1
        starts.append(max(k, starts[-1]))
    tasks, held = [], 0
    first = set(starts)
    for k, (_, _, rows_in) in enumerate(done):
        if not tasks or k in first or held + rows_in > most_rows:
            tasks.append(k)
            held = 0
        held += rows_in
    return done, starts, tasks


def whole_groups(keys: list, most: float) -> list:
    """Sorted (key, bytes, rows) with the keys of a hash joined to one cell, unless that has more than `most` bytes."""
    out: list = []
    for h, group in groupby(keys, key=lambda x: x[0][0]):
        group = list(group)
        total = sum(b for _, b, _ in group)
        out += group if total > most else [((h, 0), total, sum(n for _, _, n in group))]
    return out


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def shard_by_histogram(df: DataFrame, n_shards: int = 8, tolerance: float = 0.001, group_tolerance: float = 0.02, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), rows_per_task: int = 1_000_000, min_tasks: int = 256) -> DataFrame:
    """keep columns plus size, text_crc32, shard and slot (the rank within the shard, from 0)."""
    body = F.coalesce(F.col(text), F.lit(""))
    slim = df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], (F.octet_length(body) + 1).cast("long").alias("_b"), F.crc32(body.cast("binary")).alias("_crc"), F.xxhash64(body).alias("_h"), F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).bitwiseXOR(F.lit(-(2**63))).alias("_d"))
    slim = checkpointed(slim)
    cells, starts, tasks = splitters(slim.select("_h", "_d", "_b"), n_shards, tolerance, group_tolerance, max(min_tasks, -(-slim.count() // rows_per_task)))
    task_shard = np.array([sum(s <= k for s in starts[1:]) for k in tasks] or [0], np.int32)
    rows_before, at = [], 0
    for k, (_, _, n) in enumerate(cells):
        rows_before.append(at)
        at += n
    shard_rows = [rows_before[s] if s < len(cells) else at for s in starts]
    base = np.array([rows_before[k] - shard_rows[task_shard[i]] for i, k in enumerate(tasks)] or [0], np.int64)
    lows = [cells[k][0] for k in tasks]
    hs, ds = np.array([h for h, _ in lows] or [0], np.uint64), np.array([d for _, d in lows] or [0], np.uint64)
    names = slim.columns

    def place(b: pa.RecordBatch) -> dict:
        h = b.column(names.index("_h")).to_numpy(zero_copy_only=False).view(np.uint64)
        d = b.column(names.index("_d")).to_numpy(zero_copy_only=False).view(np.uint64)
        lo, hi = np.searchsorted(hs, h, "left"), np.searchsorted(hs, h, "right")
        for i in np.flatnonzero(hi > lo):  # keys whose hash is also a boundary's: doc_id decides
            hi[i] = lo[i] + np.searchsorted(ds[lo[i] : hi[i]], d[i], "right")
        task = np.maximum(hi - 1, 0)
        return {c: b.column(i) for i, c in enumerate(names)} | {"_task": pa.array(task, pa.int32()), "_shard": pa.array(task_shard[task], pa.int32()), "_base": pa.array(base[task], pa.int64())}

    placed = map_batches(slim, place, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema] + ["_task int", "_shard int", "_base long"]))
    unsigned = lambda c: F.col(c).bitwiseXOR(F.lit(-(2**63)))
    rank = F.row_number().over(W.partitionBy("_task").orderBy(unsigned("_h"), unsigned("_d"), "_crc", "_b"))
    return placed.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], F.col("_b").alias("size"), F.col("_crc").alias("text_crc32"), F.col("_shard").alias("shard"), (F.col("_base") + rank - 1).cast("long").alias("slot"))
