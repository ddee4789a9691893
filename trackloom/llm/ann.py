"""Nearest neighbours by inner product: score-aware anisotropic quantisation, four-bit table scans, exact reranking.

Vectors are coded two dimensions at a time with sixteen centres each. Centres and codes minimise a loss that weighs the residual
parallel to the vector more than the rest, since that is what moves a large inner product. A scan adds up table entries, two
codes (one byte) at a time; the best RERANK of each batch of the index are scored again on the original vectors in double
precision.

Codebooks are fitted on SAMPLE distinct vectors at most, the first by hash; every row is indexed. Equal vectors are one
entry with their K + 1 smallest ids (a query leaves itself out, so no more can be among its K nearest). Queries go in blocks
of QUERY_BLOCK, one after another, each a bounded broadcast, past the whole index; a task keeps the best of what it has read. Of several
vectors with one id the least is the query.

Vectors that are null, zero, or hold nulls or non-finite numbers take no part, nor do those whose length isn't the commonest
one. Ties go to the smaller id; repeated rows of an id count once; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import checkpointed, map_batches, ship, written

SAMPLE, QUERY_BLOCK, RERANK, K = 16_384, 32_768, 256, 20
THRESHOLD = 0.2  # inner products below this share of the norms don't matter


def parallel_weight(dims: int, threshold: float = THRESHOLD) -> float:
    return max(1.0, (dims - 1) * threshold**2 / (1 - threshold**2))


def encode(x: np.ndarray, books: np.ndarray, eta: float, rounds: int = 2) -> np.ndarray:
    """Codes (rows x subspaces), by coordinate descent on |r|^2 + (eta - 1) (r . x / |x|)^2."""
    n, m = len(x), books.shape[0]
    parts = x.reshape(n, m, 2)
    unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
    diff = parts[:, :, None, :] - books[None]  # rows, subspaces, centres, 2
    plain = np.einsum("nmcd,nmcd->nmc", diff, diff)
    along = np.einsum("nmcd,nmd->nmc", diff, unit)
    codes = plain.argmin(axis=2)
    at = np.arange(n)
    total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(axis=1)
    for _ in range(rounds):
        for j in range(m):
            rest = total - along[at, j, codes[:, j]]
            codes[:, j] = (plain[:, j] + (eta - 1) * (rest[:, None] + along[:, j]) ** 2).argmin(axis=1)
            total = rest + along[at, j, codes[:, j]]
    return codes


def fit(x: np.ndarray, seed: int = 3, rounds: int = 8) -> np.ndarray:
    """Codebooks: subspaces x 16 x 2. Centres are the weighted least squares solution of the same loss."""
    rng = np.random.default_rng(seed)
    n, dims = x.shape
    m = dims // 2
    parts = x.reshape(n, m, 2)
    books = np.stack([parts[rng.choice(n, 16, replace=n < 16), j] for j in range(m)]).astype(np.float64)
    books += rng.normal(0, 1e-6, books.shape)
    eta = parallel_weight(dims)
    unit = parts / np.linalg.norm(x, axis=1)[:, None, None]
    for _ in range(rounds):
        codes = np.concatenate([encode(x[k : k + 4096], books, eta, 1) for k in range(0, n, 4096)])
        for j in range(m):
            chosen = books[np.arange(m)[None], codes]
            along = np.einsum("nmd,nmd->nm", parts - chosen, unit)
            rest = along.sum(axis=1) - along[:, j]
            u, p = unit[:, j], parts[:, j]
            left = np.eye(2)[None] + (eta - 1) * u[:, :, None] * u[:, None, :]
            right = p + (eta - 1) * u * (rest + (p * u).sum(axis=1))[:, None]
            for c in range(16):
                if (own := codes[:, j] == c).any():
                    books[j, c] = np.linalg.solve(left[own].sum(axis=0), right[own].sum(axis=0))
    return books


def packed(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes to a byte; an odd last one stands with centre 0 of an empty subspace."""
    if codes.shape[1] % 2:
        codes = np.hstack([codes, np.zeros((len(codes), 1), codes.dtype)])
    return (codes[:, 0::2] | codes[:, 1::2] << 4).astype(np.uint8)


def tables(queries: np.ndarray, books: np.ndarray) -> np.ndarray:
    """queries x bytes x 256: what each packed byte adds to the inner product."""
    q = np.einsum("nmd,mcd->nmc", queries.reshape(len(queries), -1, 2), books).astype(np.float32)
    if q.shape[1] % 2:
        q = np.concatenate([q, np.zeros((len(q), 1, 16), np.float32)], axis=1)
    return (q[:, 1::2, :, None] + q[:, 0::2, None, :]).reshape(len(q), -1, 256)


def usable(df: DataFrame, vector: str, key: str) -> DataFrame:
    v = F.transform(vector, lambda x: x.cast("double"))
    good = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = df.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(good & F.col("id").isNotNull())
    dims = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (dims["n"] if dims else 0))


def build_index(rows: DataFrame, k: int = K) -> tuple[DataFrame, np.ndarray | None]:
    """(v, code, ids) of each distinct vector, checkpointed, and the codebooks."""
    # A vector that is very common is reduced in many places before it meets in one.
    salted = rows.groupBy("v", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).agg(F.collect_set("id").alias("ids")).select("v", F.slice(F.sort_array("ids"), 1, k + 1).alias("ids"))
    distinct = salted.groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    distinct = checkpointed(distinct)
    sample = [r["v"] for r in distinct.orderBy(F.xxhash64("v")).limit(SAMPLE).select("v").collect()]
    if not sample:
        return distinct.withColumn("code", F.lit(None).cast("binary")), None
    x = np.array(sample)
    if x.shape[1] % 2:
        x = np.hstack([x, np.zeros((len(x), 1))])
    books = fit(x)
    eta = parallel_weight(x.shape[1])

    def code(b: pa.RecordBatch) -> dict:
        v = matrix(b.column(0))
        c = packed(np.concatenate([encode(v[k : k + 4096], books, eta) for k in range(0, len(v), 4096)]))
        return {"v": b.column(0), "ids": b.column(1), "code": [r.tobytes() for r in c]}

    return checkpointed(map_batches(distinct.select("v", "ids"), code, "v array<double>, ids array<long>, code binary")), books


def matrix(column: pa.Array) -> np.ndarray:
    """A column of vectors of one length, with a zero added if that is odd."""
    x = np.array(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), -1)
    return np.hstack([x, np.zeros((len(x), 1))]) if x.shape[1] % 2 else x


def search(df: DataFrame, every: int = 20, k: int = K, vector: str = "embedding", key: str = "vec_id", rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of each row whose id is divisible by `every`, among all other rows."""
    spark = df.sparkSession
    ship(spark)
    rows = usable(df, vector, key)
    index, books = build_index(rows, k)
    queries = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))  # of several vectors with one id the least
    schema = "query_id long, vec_id long, score double"
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def nearest(found: DataFrame) -> DataFrame:
        # k + 1 distinct vectors hold the k nearest: at most one of them is the query's own and nobody else's
        return found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")

    parts = []
    if books is not None:
        blocks = max(1, -(-queries.count() // (QUERY_BLOCK * 3 // 4)))
        for n in range(blocks):  # a query's block is drawn by hash, so blocks are near their mean
            got = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == n).orderBy("id").collect()
            ids = np.array([r["id"] for r in got], np.int64)
            q = np.array([r["v"] for r in got]) if got else np.zeros((0, 2 * len(books)))
            if q.shape[1] % 2:
                q = np.hstack([q, np.zeros((len(q), 1))])
            # one block at a time: its queries are on the driver and in the workers only until its table is written
            body = spark.sparkContext.broadcast((ids, q, books))
            parts.append(written(nearest(index.mapInArrow(scan(body, k, rerank), schema + ", ids array<long>"))))
            body.unpersist()
    else:
        parts.append(spark.createDataFrame([], schema + ", ids array<long>"))
    near = reduce(DataFrame.unionByName, parts)
    each = near.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    return each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scan(block, k: int, rerank: int):
    """Passes a partition of the index by a block of queries; keeps each query's best k + 1 vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, books = block.value
        if not len(ids):
            return
        best = [[] for _ in ids]  # (-score, smallest id, ids)
        for b in batches:
            v = matrix(b.column(0))
            lists = b.column(1).to_pylist()
            first = np.array([x[0] for x in lists], np.int64)
            code = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(len(v), -1).T.copy()
            order = np.argsort(first, kind="stable")
            v, code, first = v[order], code[:, order], first[order]
            for at in range(0, len(ids), 256):
                part = q[at : at + 256]
                t = tables(part, books)
                for i in range(len(part)):
                    near = np.arange(len(v))
                    if len(v) > rerank:
                        rough = t[i, 0][code[0]]
                        for j in range(1, len(code)):
                            rough = rough + t[i, j][code[j]]
                        cut = np.partition(rough, len(v) - rerank)[len(v) - rerank]
                        near = np.flatnonzero(rough >= cut)
                    exact = v[near] @ part[i]
                    top = np.lexsort((first[near], -exact))[: k + 1]
                    mine = best[at + i]
                    mine += [(-float(exact[x]), int(first[near[x]]), lists[order[near[x]]]) for x in top]
                    mine.sort(key=lambda r: r[:2])
                    del mine[k + 1 :]
        for at in range(0, len(ids), 1024):
            flat = [(int(ids[n]), r) for n in range(at, min(at + 1024, len(ids))) for r in best[n]]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in flat], pa.int64()), pa.array([r[1] for _, r in flat], pa.int64()), pa.array([-r[0] for _, r in flat], pa.float64()), pa.array([r[2] for _, r in flat], pa.list_(pa.int64()))], names=["query_id", "vec_id", "score", "ids"])

    return run
