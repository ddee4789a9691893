"""Exact substring dedup with sharded automata of recurring phrases.

A window is `window` consecutive words of one document. Each window has an anchor: of its runs of GRAM words the one with the
smallest hash, the leftmost of equals. Equal windows have equal anchors, and about a tenth of all places are anchors, so
counting anchors finds every place where a window can recur. What surrounds a recurring anchor (its windows) goes to the shard of
the anchor. There windows that seem to recur, by a rolling hash, are compiled into an Aho-Corasick automaton over
words, the shard's segments are streamed through it, and a window that matches at two places or more is confirmed word for word.

An anchor with more than HOT places would make a shard of its own too large. Its segments are first reduced to distinct ones
with counts; their windows are counted by a 128-bit hash in a spread aggregation, and the answer is joined back.

Two bitmaps of BITMAP bits, whatever the size of the corpus, spare the shuffle what cannot recur; a false hit costs a
row and changes no result. Nulls count as texts without words; texts of any length are read whole; a repeated row is
another document, so its windows recur; a null doc_id is a value like any other.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import checkpointed, gathered, map_batches, ship, written

GRAM = 16
HOT = 50_000
SALTS = 64
BITMAP = 1 << 27
SEGMENTS_IN_SHARD, SEGMENTS_AT_ONCE = 6000, 1500

_M = np.uint64(0x9E3779B97F4A7C15)
_MINV = np.uint64(pow(int(_M), -1, 1 << 64))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        m = max(4096, 2 * n)
        with np.errstate(over="ignore"):
            for name, base in (("up", _M), ("down", _MINV)):
                p = np.full(m, base, np.uint64)
                p[0] = 1
                _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(11)), np.uint64, len(words))


def gram_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of size words, whatever its place, from prefix sums of a polynomial mod 2**64, then mixed."""
    n = len(h)
    up, down = _powers(n)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * down, dtype=np.uint64)])
        g = (sums[size:] - sums[:-size]) * up[: n - size + 1]
        g ^= g >> np.uint64(33)
        g *= np.uint64(0xFF51AFD7ED558CCD)
        g ^= g >> np.uint64(33)
        g *= np.uint64(0xC4CEB9FE1A85EC53)
        g ^= g >> np.uint64(33)
    return g


def anchors(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, last window) of each anchor of a document, in order."""
    if len(words) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = gram_hashes(word_hashes(words), GRAM)
    span = window - GRAM + 1
    at = np.lib.stride_tricks.sliding_window_view(g, span).argmin(axis=1) + np.arange(len(words) - window + 1)
    new = np.flatnonzero(np.diff(at, prepend=-1))
    return g[at[new]], new, np.append(new[1:], len(at)) - 1


def words_of(batch: pa.RecordBatch, i: int) -> list[list[bytes]]:
    return [b"".split() if t is None else t.split() for t in batch.column(i).cast(pa.binary()).to_pylist()]


def bitmap(rows: DataFrame, column: str = "anchor", bits: int = BITMAP) -> bytes:
    """A bitmap of a column modulo bits, a power of two; at most so many bits come to the driver."""
    x = (F.pmod(column, F.lit(bits)) + 1).alias("x")
    made = rows.select(x).groupBy(F.expr("bitmap_bucket_number(x)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(x))").alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in gathered(made):
        out[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.tobytes()


def hit(bits: bytes, anchor: np.ndarray) -> np.ndarray:
    x = anchor & np.uint64(8 * len(bits) - 1)
    return (np.frombuffer(bits, np.uint8)[x >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8)) & 1 == 1


def spans_of(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Sorted starts of covering windows as joined (from, to) ranges of words."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > window) + 1
    return [(int(p[0]), int(p[-1]) + window) for p in np.split(starts, cut)]


class _Codes(dict):
    """Words as three letters. A state's followers are searched in turn, so the alphabet is small; each place has letters of its own, so matches begin at words."""

    def __missing__(self, w: bytes) -> str:
        n = len(self)
        self[w] = c = chr(1 + n % 64) + chr(65 + n // 64 % 64) + chr(129 + n // 4096)
        return c


def locate(segments: list[list[bytes]], window: int, times: list[int] | None = None) -> list[np.ndarray]:
    """For each distinct segment the starts of its windows that occur at two places or more; times: how often each segment occurs.

    Windows of a segment that occurs again are confirmed by that; the automaton is for windows that different segments seem to share.
    """
    if not segments:
        return []
    times = times or [1] * len(segments)
    hashes = [gram_hashes(word_hashes(s), window) for s in segments]
    sizes = [len(h) for h in hashes]
    _, inverse, counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    again = np.split(counts[inverse] > 1, np.cumsum(sizes)[:-1])
    starts: list[set[int]] = [set(range(n)) if t > 1 else set() for n, t in zip(sizes, times)]
    live = [k for k, some in enumerate(again) if some.any()]
    if not live:
        return [np.array(sorted(s), np.int64) for s in starts]
    code = _Codes()
    seqs = {k: "".join(map(code.__getitem__, segments[k])) for k in live}
    auto = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    added: set[str] = set()
    for k in live:
        for i in np.flatnonzero(again[k]).tolist():
            phrase = seqs[k][3 * i : 3 * (i + window)]
            if phrase not in added:
                added.add(phrase)
                auto.add_word(phrase, len(added))
    auto.make_automaton()
    places: dict[int, list[tuple[int, int]]] = {}
    for k in live:
        for end, phrase in auto.iter(seqs[k]):
            places.setdefault(phrase, []).append((k, end // 3 - window + 1))
    for found in places.values():
        if len(found) > 1:
            for k, i in found:
                starts[k].add(i)
    return [np.array(sorted(s), np.int64) for s in starts]


def covered_spans(df: DataFrame, window: int = 35, text: str = "text", key: str = "doc_id", hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """The documents with their keys (_id, _h), and per key the ranges of words that recurring windows cover."""
    ship(df.sparkSession)
    docs = df.withColumns({"_id": F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))), "_h": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    slim = docs.select("_id", "_h", F.col(text).alias("text"))

    def count(b: pa.RecordBatch) -> dict:
        found = [anchors(w, window)[0] for w in words_of(b, 0)]
        values, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
        return {"anchor": pa.array(values.view(np.int64)), "n": pa.array(n, pa.int64())}

    seen = map_batches(slim.select("text"), count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    seen = checkpointed(seen)
    total = seen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sc = df.sparkSession.sparkContext
    all_bits, hot_bits = sc.broadcast(bitmap(seen)), sc.broadcast(bitmap(seen.where(F.col("n") > hot)))  # BITMAP bits each
    shards = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SEGMENTS_IN_SHARD))

    def cut(b: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"_id": [], "_h": [], "anchor": [], "hot": [], "at": [], "seg": []}
        for one, h, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), words_of(b, 2)):
            a, first, last = anchors(words, window)
            if not len(a):
                continue
            keep = np.flatnonzero(hit(all_bits.value, a))
            warm = hit(hot_bits.value, a[keep])
            signed = a.view(np.int64)
            for k, is_hot in zip(keep.tolist(), warm.tolist()):
                out["_id"].append(one)
                out["_h"].append(h)
                out["anchor"].append(int(signed[k]))
                out["hot"].append(is_hot)
                out["at"].append(int(first[k]))
                out["seg"].append(b" ".join(words[first[k] : last[k] + window]))
        return out

    segments = map_batches(slim, cut, "_id long, _h long, anchor long, hot boolean, at int, seg binary")
    some_hot = not seen.where(F.col("n") > hot).isEmpty()
    if some_hot:
        segments = written(segments)  # the usual and the hot branch both read it

    def in_shard(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("anchor").to_numpy(), kind="stable")
        t = t.take(pa.array(order))
        a = t.column("anchor").to_numpy()
        ids, hs, ats = (t.column(c).to_numpy() for c in ("_id", "_h", "at"))
        out = ([], [], [], [])
        edges = np.append(np.flatnonzero(np.diff(a, prepend=a[0] - 1 if len(a) else 0)), len(a))
        k = 0
        while k < len(edges) - 1:  # whole anchors, SEGMENTS_AT_ONCE segments to an automaton
            j = max(k + 1, int(np.searchsorted(edges, edges[k] + SEGMENTS_AT_ONCE, "right")) - 1)
            rows = range(int(edges[k]), int(edges[j]))
            texts: dict[bytes, list[int]] = {}
            for i, seg in zip(rows, t.column("seg").slice(rows.start, len(rows)).to_pylist()):
                texts.setdefault(seg, []).append(i)
            found = locate([seg.split(b" ") for seg in texts], window, [len(x) for x in texts.values()])
            for same, starts in zip(texts.values(), found):
                for lo, hi in spans_of(starts, window):
                    for i in same:
                        for c, v in zip(out, (ids[i], hs[i], ats[i] + lo, ats[i] + hi)):
                            c.append(int(v))
            k = j
        return pa.table({"_id": pa.array(out[0], pa.int64()), "_h": pa.array(out[1], pa.int64()), "lo": pa.array(out[2], pa.int32()), "hi": pa.array(out[3], pa.int32())})

    usual = segments.where("not hot").select("_id", "_h", "anchor", "at", "seg", F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")).groupBy("shard").applyInArrow(in_shard, "_id long, _h long, lo int, hi int")
    spans = usual
    if some_hot:
        spans = spans.unionByName(hot_spans(segments.where("hot"), window))
    return docs, spans.groupBy("_id", "_h").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def hot_spans(segments: DataFrame, window: int) -> DataFrame:
    """As the shards do, for anchors with very many places: by distinct segments and spread counts of their windows."""
    named = segments.select("_id", "_h", "at", "seg", F.xxhash64("seg").alias("s1"), F.xxhash64(F.lit(3), F.col("seg")).alias("s2"))
    distinct = named.groupBy("s1", "s2").agg(F.first("seg").alias("seg"), F.count("*").alias("n"))

    def windows(b: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"s1": [], "s2": [], "i": [], "w1": [], "w2": [], "n": []}
        for s1, s2, seg, n in zip(*(b.column(c).to_pylist() for c in range(4))):
            words = seg.split(b" ")
            for i in range(len(words) - window + 1):
                d = xxhash.xxh3_128_digest(b" ".join(words[i : i + window]))
                for c, v in zip(out, (s1, s2, i, int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), n)):
                    out[c].append(v)
        return out

    each = checkpointed(map_batches(distinct.select("s1", "s2", "seg", "n"), windows, "s1 long, s2 long, i int, w1 long, w2 long, n long"))
    again = each.groupBy("w1", "w2").agg(F.sum("n").alias("all")).where("all > 1").drop("all")
    starts = each.join(again, ["w1", "w2"]).groupBy("s1", "s2").agg(F.collect_list("i").alias("starts"))
    # one segment may stand at most places: its starts are dealt to SALTS parts
    salted = starts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = named.select("_id", "_h", "at", "s1", "s2", F.pmod(F.xxhash64("_id", "at"), F.lit(SALTS)).cast("int").alias("part")).join(salted, ["s1", "s2", "part"])
    return found.select("_id", "_h", F.explode(F.transform("starts", lambda i: F.struct((F.col("at") + i).alias("lo"), (F.col("at") + i + window).alias("hi")))).alias("s")).select("_id", "_h", "s.lo", "s.hi")


def drop_repeats(df: DataFrame, window: int = 35, text: str = "text", key: str = "doc_id", hot: int = HOT, digest: bool = False) -> DataFrame:
    """The rows with n_words, n_removed and kept (the words left, joined by one space), or kept_sha256 if only that is asked for."""
    docs, spans = covered_spans(df, window, text, key, hot)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), "_id", "_h").join(spans, ["_id", "_h"], "left").select("_key", "_text", "spans")
    kind = docs.schema[key].dataType.simpleString()

    def strip(b: pa.RecordBatch) -> dict:
        n, removed, kept = [], [], []
        for words, found in zip(words_of(b, 1), b.column(2).to_pylist()):
            n.append(len(words))
            if found:
                keep = np.ones(len(words), bool)
                for s in found:
                    keep[s["lo"] : s["hi"]] = False
                words = [w for w, k in zip(words, keep.tolist()) if k]
            removed.append(n[-1] - len(words))
            left = b" ".join(words)
            kept.append(hashlib.sha256(left).hexdigest() if digest else left.decode("utf-8", "replace"))
        return {key: b.column(0), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256" if digest else "kept": pa.array(kept, pa.string())}

    return map_batches(rows, strip, f"`{key}` {kind}, n_words long, n_removed long, {'kept_sha256' if digest else 'kept'} string")
