"""SimHash near-duplicates with pigeonring filtering.

A fingerprint of 64 bits is a ring of 16 segments of 4 bits. If two fingerprints differ in at most t bits, then some
chain of consecutive segments stays within its proportional budget at each length: its first l segments differ in at
most l*t/16 bits. For t = 2 the first seven must be equal, so fingerprints are dealt to 16 buckets by 28 bits each; a
bucket's pairs pass the whole chain test before the full Hamming check.

A bucket of more than BUCKET fingerprints isn't paired. Two fingerprints differ in at most two bits exactly if both are
within one bit of a third; so each of them names the points one flip away (only bits outside the bucket's key can differ),
and those that name the same point, 37 at most, are linked. That is as exact, and linear.

Nulls count as empty texts; an empty text has fingerprint zero, linked like any other; texts are hashed whole; a row
without doc_id links others but is never a component's smallest id (its own is null if no other has one).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import checkpointed, gathered, map_batches, remove, ship, texts, written
from .components import connected_components
from .substring import bitmap, gram_hashes, hit, word_hashes

SEGMENTS, WIDTH = 16, 4
BUCKET = 32


def shingles(text: str, size: int) -> list[bytes]:
    """Word shingles as bytes: A-Z lowered, words between ASCII white space, joined by one space; fewer words: all of them."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [joined]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    return [joined[a:b] for a, b in zip(starts[: len(words) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist())]


def fingerprint(items: list[bytes], seed: int = 42) -> int:
    """A bit is 1 if it is 1 in over half of the items' hashes."""
    if not items:
        return 0
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(x, seed) for x in items), "<u8", len(items)))


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is 1 in over half of the hashes."""
    over = np.zeros(64, np.int64)
    for k in range(0, hashes.size, 1 << 16):
        h = hashes[k : k + (1 << 16)].astype("<u8", copy=False)
        over += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * over > hashes.size, bitorder="little").tobytes(), "little")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(df: DataFrame, shingle: int = 3, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns and fp, the fingerprint as a long."""
    kept = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]

    def run(b: pa.RecordBatch) -> dict:
        return {c: b.column(i) for i, c in enumerate(keep)} | {"fp": pa.array([signed(fingerprint(shingles(t, shingle))) for t in texts(b, text)], pa.int64())}

    return map_batches(df.select(*keep, text), run, ", ".join([*kept, "fp long"]))


def rotated(fp: Column, i: Column) -> Column:
    """The ring turned so that segment i comes first, at the high end."""
    k = (i * WIDTH).cast("int")
    return F.when(i == 0, fp).otherwise(F.call_function("shiftleft", fp, k).bitwiseOR(F.call_function("shiftrightunsigned", fp, F.lit(64) - k)))


def chain_segments(max_diff: int) -> int:
    """How many first segments of a chain have a budget below one bit, hence are equal."""
    return next(n for n in range(SEGMENTS, 0, -1) if n * max_diff < SEGMENTS)


def buckets(fps: DataFrame, max_diff: int) -> DataFrame:
    """fps (id, fp) dealt to one bucket for each start of a chain: id, turned (the ring from there), bucket."""
    n = chain_segments(max_diff)
    if n < 5:
        raise ValueError("the equal segments of a chain make too short a key for this many differing bits")
    i = F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))).alias("i")
    out = fps.select("id", "fp", i).select("id", "i", rotated(F.col("fp"), F.col("i")).alias("turned"))
    key = F.shiftrightunsigned("turned", 64 - n * WIDTH)
    return out.select("id", "turned", (key * SEGMENTS + F.col("i")).alias("bucket"))


def chain_holds(x: Column, max_diff: int) -> Column:
    """x: the differing bits of two rings from a bucket's start. Each first l segments are within l*max_diff/16."""
    out = F.lit(True)
    for n in range(chain_segments(max_diff) + 1, SEGMENTS + 1):
        out = out & (F.bit_count(F.shiftrightunsigned(x, 64 - n * WIDTH)) <= n * max_diff // SEGMENTS)
    return out


def links(fps: DataFrame, max_diff: int = 2) -> DataFrame:
    """(a, b): links that connect what is within max_diff bits. fps: distinct fp by id. Each link is a true one or, in a full bucket, to the smallest of a set of mutual neighbours."""
    rows = buckets(fps, max_diff)
    many = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    rows = checkpointed(rows.join(many, "bucket"))
    small = rows.where(F.col("n") <= BUCKET).groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("id", "turned"))).alias("all"))
    first = small.select("all", F.posexplode("all").alias("k", "one")).where(F.col("k") + 1 < F.size("all"))
    apart = lambda o: o["turned"].bitwiseXOR(F.col("one.turned"))
    near = F.filter(F.slice("all", F.col("k") + 2, F.size("all")), lambda o: chain_holds(apart(o), max_diff) & (F.bit_count(apart(o)) <= max_diff))
    pairs = first.select(F.col("one.id").alias("a"), F.explode(F.transform(near, lambda o: o["id"])).alias("b"))
    full = rows.where(F.col("n") > BUCKET)
    if max_diff != 2:
        if full.limit(1).count():
            raise ValueError("full buckets are exact for two differing bits only")
        return pairs
    free = 64 - chain_segments(max_diff) * WIDTH
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k) for k in range(free)])
    points = full.select("bucket", "id", F.explode(F.transform(flips, lambda m: F.col("turned").bitwiseXOR(m))).alias("point"))
    met = points.groupBy("bucket", "point").agg(F.collect_set("id").alias("ids")).where(F.size("ids") > 1)
    return pairs.unionByName(met.select(F.array_min("ids").alias("a"), F.explode("ids").alias("b")).where("a <> b"))


def near_duplicates(df: DataFrame, shingle: int = 3, max_diff: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, one row for each row."""
    rows = checkpointed(fingerprints(df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), shingle))
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    # fingerprints are the graph's nodes; their own bits are the ids, and the smallest doc_id is found afterwards
    groups = connected_components(links(fps.select(F.col("fp").alias("id"), "fp"), max_diff))
    named = fps.join(groups, fps["fp"] == groups["id"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "component").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- Pipeline: near-duplicates by five-word shingles, similarity 0.8 -------------------------------------------------------


#: Shingles known as common ones, and the documents that make one common. Any order gives the same result; this one keeps buckets small.
COMMON, OFTEN = 1 << 16, 8
#: Members of a bucket that are paired at most; pairs that one copy of a text's set serves.
FEW, ROUND_HUB = 32, 1_000
#: Members of a hub, of so many shingles at most, by which the order of its differences is judged; differences known as common ones. Any order gives the same result.
JUDGES, LONGEST, KNOWN = 128, 1_000, 4_096
#: What sets a member h apart from its hub a: e, one of the `size` shingles that only one of them has, and its place `at`; e is null in a member's one row about itself.
#: far: not joined to the hub; first: in the part that must meet members further away.
APART = "a long, h long, e long, at int, size int, over double, far boolean, first boolean"


def shingle_set(text: str, size: int) -> np.ndarray:
    """The distinct word shingles of a text as 64-bit hashes, in their order; shorter texts: all words as one."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    found = np.sort(gram_hashes(word_hashes(words), min(size, len(words))))
    return found[np.concatenate([[True], found[1:] != found[:-1]])]


def rare_first(hashes: np.ndarray, common: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The set in the one order all texts share: unknown shingles by hash, then the common ones by rising frequency."""
    if not common.size or not hashes.size:
        return hashes
    at = np.minimum(np.searchsorted(common, hashes), common.size - 1)
    return hashes[np.argsort(np.where(common[at] == hashes, ranks[at], -1), kind="stable")]


def prefix_length(n: int, similarity: float) -> int:
    """Two sets of at least this similarity share an element of their first so many, in any common order."""
    return n - math.ceil(similarity * n - 1e-9) + 1


def segment_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the set fall to each segment of the ring of hashes; about four to a segment."""
    n = 8
    while 4 * n < hashes.size:
        n *= 2
    return np.bincount((hashes & np.uint64(n - 1)).astype(np.int64), minlength=n).astype(np.uint16)


def packed(counts: np.ndarray) -> bytes:
    """Counts in one byte each where all fit, else in two; the first byte says which."""
    return b"\1" + counts.astype(np.uint8).tobytes() if counts.max() < 256 else b"\2" + counts.astype("<u2").tobytes()


def unpacked(made: bytes) -> np.ndarray:
    return np.frombuffer(made, np.uint8 if made[0] == 1 else "<u2", offset=1).astype(np.int64)


def ring_holds(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sets can be so similar by their segment counts. Equal segments differ by at least the difference of their counts, and all
    by at most the budget; a chain of all segments with every start of it within its share of the budget exists exactly if the sum is."""
    while x.size > y.size:
        x = x[: x.size // 2] + x[x.size // 2 :]
    while y.size > x.size:
        y = y[: y.size // 2] + y[y.size // 2 :]
    x, y = x.astype(np.int64), y.astype(np.int64)
    return int(np.abs(x - y).sum()) <= (1 - similarity) / (1 + similarity) * int(x.sum() + y.sum()) + 1e-6


def middle(rows: DataFrame, by: str) -> DataFrame:
    """by, n and middle of rows (by, n, fp): the bits that over half of a bucket's fingerprints have."""
    bit = lambda i: F.sum(F.shiftrightunsigned("fp", i).bitwiseAND(F.lit(1)))
    counts = rows.groupBy(by).agg(F.max("n").alias("n"), F.array(*[bit(i) for i in range(64)]).alias("bits"))
    ones = F.transform("bits", lambda x, i: F.when(2 * x > F.col("n"), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(0))
    return counts.select(by, "n", F.aggregate(ones, F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y)).alias("middle"))


def with_orders(members: DataFrame, sets: DataFrame) -> DataFrame:
    """h and set of each hub a of members (a, b): its number of shingles, these, and the differences from it that a few members share, common ones last."""
    n = members.groupBy("a").agg(F.count("*").alias("n"))
    few = members.join(n, "a").where(F.pmod(F.xxhash64("b", "a"), F.col("n")) < JUDGES).join(sets.where(F.octet_length("set") <= 8 * LONGEST).withColumnRenamed("h", "b"), "b")
    few = few.groupBy("a").agg(F.slice(F.collect_list("set"), 1, JUDGES).alias("sets"))
    hubs = n.select("a").join(sets.withColumnRenamed("h", "a"), "a").join(few, "a", "left")

    def run(b: pa.RecordBatch) -> dict:
        out = []
        for own, others in zip(b.column(1), b.column(2).to_pylist()):
            p = np.frombuffer(own.as_buffer(), np.uint64)
            e, n = np.unique(np.concatenate([p[:0], *[np.setxor1d(p, np.frombuffer(x, np.uint64), assume_unique=True) for x in others or ()]]), return_counts=True)
            e, n = e[n > 1], n[n > 1]
            out.append(np.concatenate([np.array([p.size], np.uint64), p, e[np.lexsort((e, n))][-KNOWN:]]).tobytes())
        return {"h": b.column(0), "set": pa.array(out, pa.binary())}

    return written(map_batches(hubs.select("a", "set", "sets"), run, "h long, set binary"))


def apart(batch: pa.RecordBatch, similarity: float, enough) -> dict:
    """Rows of APART for pairs (a, b, x: the hub with its order, y: the member's set).

    Let E be the shingles that only one of a text and its hub has, p and n their numbers of shingles and r = (1 - similarity) / (1 + similarity). Two texts are similar
    if their sets differ in r(n + m) places at most, hence exactly if their E share at least half the sum of their `over` = |E| - rn. A text is joined to the hub if
    over <= rp, and over >= -rp always holds: so two texts that aren't both joined to the hub share something. The nearer one can't be
    more than 2rn/similarity below the further one. So each must meet the other within a prefix of its E, in an order common to the hub's members.
    """
    r = (1 - similarity) / (1 + similarity)
    out: dict[str, list] = {c: [] for c in ("a", "h", "e", "at", "size", "over", "far", "first")}
    for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
        x, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
        p, known = x[1 : 1 + int(x[0])], x[1 + int(x[0]) :]
        e = np.setxor1d(p, q, assume_unique=True)
        by = np.argsort(known)
        e = rare_first(e, known[by], by)
        over, far = e.size - r * q.size, not enough((p.size + q.size - e.size) // 2, p.size, q.size)
        length = lambda t: max(0, e.size - max(1, math.ceil(t - 1e-6)) + 1)
        first = length((over + max(over, r * p.size)) / 2)
        most = max(first, length(max(over - r * q.size / similarity, (over - r * p.size) / 2))) if far else first
        out["e"] += [None, *e[:most].view(np.int64).tolist()]
        out["at"] += [-1, *range(most)]
        out["first"] += [False, *[k < first for k in range(most)]]
        for c, v in (("a", a), ("h", b), ("size", e.size), ("over", over), ("far", far)):
            out[c] += [v] * (most + 1)
    return {c: pa.array(out[c], t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.bool_(), pa.bool_()))}


def drop_near_duplicates(df: DataFrame, shingle: int = 5, similarity: float = 0.8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The same columns; of each group of near-duplicates the row with the smallest doc_id (nulls last) stays.

    First come texts whose fingerprints (of the same shingles) differ in at most two bits, found by pigeonring buckets. Pairs of this similarity may differ
    in more bits, so an exact search follows: texts are dealt to a bucket for each shingle of their prefix in an order common to all texts, with the
    shingles that most documents hold last. In a bucket of at most FEW texts every pair is compared that isn't joined yet and whose sizes, places in the
    prefix and segment counts still allow the similarity. In a larger one each text is compared with a hub, and two that aren't both joined to it meet only
    if they share enough of what sets them apart from it (see apart()). A pair that is joined already can't change the groups.
    Texts are compared by exact Jaccard similarity of their shingle sets. Texts without words count as equal, null ones are texts without words.
    Of rows with the same doc_id and text one stays, by a hash of the row. An empty table gives an empty result; columns may have any names.
    Texts are told apart by 64 bits while groups are made, so two texts could be mistaken for one with a chance of 2**-64 a pair.
    """
    spark = df.sparkSession
    cols = df.columns
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    own = F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(2**63 - 1))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), own.alias("id"), F.xxhash64(body).alias("h"), F.xxhash64(F.reverse(body)).alias("g"))
    src = df.select(F.xxhash64(body).alias("h"), body.alias("text"))
    ship(spark)

    def flat(emit, schema: str, *more) -> DataFrame:
        return map_batches(src, lambda b: emit(b.column(0).to_numpy(), texts(b, "text"), *more), schema)

    def first_of(sets: list[np.ndarray]) -> list[np.ndarray]:
        # a text without words has one made-up shingle, so that it meets others of its kind
        return [x[: prefix_length(x.size, similarity)] if x.size else np.zeros(1, np.uint64) for x in sets]

    def by_hash(h: np.ndarray, bodies: list[str]) -> dict:
        found = np.concatenate(first_of([shingle_set(t, shingle) for t in bodies]))
        s, n = np.unique(found, return_counts=True)
        return {"s": pa.array(s.view(np.int64)), "n": pa.array(n)}

    often = flat(by_hash, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "s").limit(COMMON)
    often = sorted((r["s"] % (1 << 64), r["n"]) for r in gathered(often))  # COMMON rows at most
    order = spark.sparkContext.broadcast((np.array([x for x, _ in often], np.uint64), np.array([n for _, n in often], np.int64)))

    def prefixes(bodies: list[str]) -> list[np.ndarray]:
        return first_of([rare_first(shingle_set(t, shingle), *order.value) for t in bodies])

    def by_order(h: np.ndarray, bodies: list[str]) -> dict:
        found = prefixes(bodies)
        return {"s": pa.array(np.concatenate(found).view(np.int64)), "h": pa.array(np.repeat(h, [x.size for x in found]))}

    met = flat(by_order, "s long, h long").groupBy("s").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("s")
    shared = spark.sparkContext.broadcast(bitmap(met, "s", 1 << 25))

    def cards(h: np.ndarray, bodies: list[str]) -> dict:
        """Of texts that share a prefix shingle: its fingerprint, size, segment counts, and those shingles with their places."""
        out: dict[str, list] = {c: [] for c in ("h", "fp", "size", "ring", "s", "at")}
        for one, t in zip(h.tolist(), bodies):
            full = rare_first(shingle_set(t, shingle), *order.value)
            (first,) = first_of([full])
            at = np.flatnonzero(hit(shared.value, first))
            if at.size:
                for c, v in zip(out, (one, signed(majority(full)), full.size, packed(segment_counts(full)), first[at].view(np.int64), at.astype(np.int32))):
                    out[c].append(v)
        return {"h": pa.array(out["h"], pa.int64()), "fp": pa.array(out["fp"], pa.int64()), "size": pa.array(out["size"], pa.int32()), "ring": pa.array(out["ring"], pa.binary()), "s": pa.array(out["s"], pa.list_(pa.int64())), "at": pa.array(out["at"], pa.list_(pa.int32()))}

    held_cards = written(flat(cards, "h long, fp long, size int, ring binary, s array<long>, at array<int>").dropDuplicates(["h"]))
    posts = held_cards.select("h", "size", F.explode(F.arrays_zip("s", "at")).alias("p")).select("h", "size", "p.s", "p.at")
    rings = held_cards.select("h", "ring")

    def sets_of(h: np.ndarray, bodies: list[str], wanted) -> dict:
        some = np.flatnonzero(hit(wanted.value, h.view(np.uint64))).tolist()
        once = {int(h[i]): bodies[i] for i in some}
        return {"h": pa.array(list(once), pa.int64()), "set": pa.array([shingle_set(t, shingle).tobytes() for t in once.values()], pa.binary())}

    def sets_for(pairs: DataFrame) -> DataFrame:
        """h and set of every text that is an a or b of pairs, and of a few others."""
        wanted = spark.sparkContext.broadcast(bitmap(pairs.select(F.explode(F.array("a", "b")).alias("h")), "h", 1 << 24))
        sets = written(flat(sets_of, "h long, set binary", wanted).dropDuplicates(["h"]))
        wanted.unpersist()
        return sets

    def can_be(b: pa.RecordBatch) -> dict:
        ok = [ring_holds(*(unpacked(v.as_py()) for v in both), similarity) for both in zip(b.column(2), b.column(3))]
        return {"a": b.column(0), "b": b.column(1), "ok": pa.array(ok, pa.bool_())}

    def enough(same: int, n: int, m: int) -> bool:
        return same >= similarity * (n + m - same) - 1e-9

    def alike(b: pa.RecordBatch) -> dict:
        ok = []
        for both in zip(b.column(2), b.column(3)):
            p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in both)
            ok.append(enough(np.intersect1d(p, q, assume_unique=True).size, p.size, q.size))
        return {"a": b.column(0), "b": b.column(1), "ok": pa.array(ok, pa.bool_())}

    def with_both(pairs: DataFrame, values: DataFrame, c: str, first: DataFrame | None = None) -> DataFrame:
        """pairs with x and y, the values of a and b (those of a from first, if given). Many pairs may share a: its value is dealt to as many parts as it has thousands of pairs."""
        parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / ROUND_HUB).alias("parts"))
        dealt = (values if first is None else first).withColumnRenamed("h", "a").join(parts, "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col(c).alias("x"), "parts")
        most = gathered(parts.agg(F.coalesce(F.max("parts"), F.lit(1))))[0][0]
        right = pairs.join(values.withColumnRenamed("h", "b"), "b").select("a", "b", F.col(c).alias("y"))
        if most == 1:
            return right.join(dealt.drop("part", "parts"), "a").select("a", "b", "x", "y")
        right = right.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")))
        return right.join(dealt.drop("parts"), ["a", "part"]).select("a", "b", "x", "y")

    def true_ones(pairs: DataFrame) -> DataFrame:
        kept = checkpointed(map_batches(with_both(checkpointed(pairs), rings, "ring"), can_be, "a long, b long, ok boolean").where("ok").select("a", "b"))
        sets = sets_for(kept)
        true = checkpointed(map_batches(with_both(kept, sets, "set"), alike, "a long, b long, ok boolean").where("ok").select("a", "b"))
        remove(sets)
        return true

    def dealt_to(one: DataFrame, parts: Column) -> DataFrame:
        """One row a bucket, for each of its parts."""
        return one.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("n")

    def named(df: DataFrame, groups: DataFrame) -> DataFrame:
        return df.join(groups.withColumnRenamed("id", "h"), "h", "left").withColumn("c", F.coalesce("component", "h")).drop("component")

    # 1. Fingerprints within two bits, found by pigeonring buckets; texts of one fingerprint are compared with the least of them
    fps = held_cards.groupBy("fp").agg(F.min("h").alias("least"))
    same_fp = held_cards.join(fps, "fp").select(F.col("least").alias("a"), F.col("h").alias("b")).where("a <> b")
    near_fp = links(fps.select(F.col("fp").alias("id"), "fp"))
    near_fp = near_fp.join(fps.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(fps.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    found = true_ones(same_fp.unionByName(near_fp.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct())
    groups = checkpointed(connected_components(found))

    # 2. What fingerprints can't reach: all pairs of the buckets that hold few texts, not joined yet
    open_ = named(posts, groups)
    mixed = open_.groupBy("s").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("s", "n")
    open_ = written(open_.join(mixed, "s"))
    few, many = open_.where(F.col("n") <= FEW), open_.where(F.col("n") > FEW)
    # what a pair must still be able to share, at the first shingle that both have
    least = F.lit(similarity / (1 + similarity)) * (F.col("x.size") + F.col("y.size")) - F.lit(1e-6)
    fits = F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at")) >= least
    near = few.alias("x").join(few.alias("y"), (F.col("x.s") == F.col("y.s")) & (F.col("x.c") < F.col("y.c")) & fits)
    found = found.unionByName(true_ones(near.select(F.least("x.h", "y.h").alias("a"), F.greatest("x.h", "y.h").alias("b")).distinct()))

    # 3. The other buckets: their members by what sets them apart from a hub, the text whose fingerprint is nearest to the majority of theirs
    parts = F.ceil(F.col("n") / ROUND_HUB).cast("long")
    many = many.withColumn("part", F.pmod(F.xxhash64("h"), parts)).join(held_cards.select("h", "fp"), "h")
    centres = middle(many, "s")
    nearest = many.join(dealt_to(centres, parts), ["s", "part"]).groupBy("s").agg(F.min(F.struct(F.bit_count(F.col("fp").bitwiseXOR(F.col("middle"))).alias("d"), F.xxhash64("h").alias("o"), "h")).alias("hub"), F.max("n").alias("n"))
    members = many.join(dealt_to(nearest.select("s", "n", F.col("hub.h").alias("a")), parts), ["s", "part"])
    members = checkpointed(members.select("a", F.col("h").alias("b")).where("a <> b").distinct())
    sets = sets_for(members)
    orders = with_orders(members, sets)
    spread_out = written(map_batches(with_both(members, sets, "set", orders), lambda b: apart(b, similarity, enough), APART))
    remove(sets)
    found = found.unionByName(spread_out.where("e is null and not far").select("a", F.col("h").alias("b")))
    groups = checkpointed(connected_components(found))
    differ = named(spread_out.where("e is not null"), groups)
    some = differ.groupBy("a", "e").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("a", "e")
    differ = written(differ.join(some, ["a", "e"]))
    # x is a member further from the hub than y: what a pair must still share of what sets it apart, at the first shingle of it that both have
    further = F.struct("x.over", "x.h") > F.struct("y.over", "y.h")
    rest = F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at")) >= (F.col("x.over") + F.col("y.over")) / 2 - F.lit(1e-6)
    near = differ.where("far").alias("x").join(differ.where("first").alias("y"), (F.col("x.a") == F.col("y.a")) & (F.col("x.e") == F.col("y.e")) & (F.col("x.c") != F.col("y.c")) & further & rest)
    found = found.unionByName(true_ones(near.select(F.least("x.h", "y.h").alias("a"), F.greatest("x.h", "y.h").alias("b")).distinct()))
    groups = checkpointed(connected_components(found))
    for made in (held_cards, open_, orders, spread_out, differ):
        remove(made)
    keys = rows.groupBy("h", "g", "id").agg(F.count("*").alias("n"))
    labelled = written(named(keys, groups))
    best = labelled.groupBy("c").agg(F.min(F.struct("id", "h", "g")).alias("best"))
    marked = labelled.join(best, "c").select("h", "g", "id", "n", (F.struct("id", "h", "g") == F.col("best")).alias("stays"))
    gone = written(marked.where("not stays or n > 1"))
    # the id is in the key, so copies of one text are many keys; the side of what goes is the smaller one
    kept = rows.join(gone.select("h", "g", "id"), ["h", "g", "id"], "left_anti").select("row.*")
    first = W.partitionBy("h", "g", "id").orderBy(F.xxhash64(F.to_json("row")))
    tied = rows.join(gone.where("stays").select("h", "g", "id"), ["h", "g", "id"], "left_semi").withColumn("k", F.row_number().over(first)).where("k = 1").select("row.*")
    return kept.unionByName(tied)
