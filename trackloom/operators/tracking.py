"""Multi-object tracking as one pass over sorted rows, and what is derived from tracks.

Matching never crosses a cut, and no track outlives a gap of max_gap, so an (entity, label) timeline falls into independent
segments; rows are dealt by segment, sorted, and streamed through the tracker, which holds its live and unconfirmed tracks only.
Within a segment frames are taken in order; live tracks and new boxes are assigned one to one: as many pairs as possible, then
the least sum of centre distances.

With styles, a track's look is drawn once, and a label's looks depend on each other over cuts (dwell), so a segment is
then a whole (entity, label).
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F


@dataclass(frozen=True)
class Style:
    """A look with its weight in the draw, and its own safety (share of the size added), if any."""

    name: str
    weight: float = 1.0
    x_safety: float | None = None
    y_safety: float | None = None


@dataclass(frozen=True)
class Settings:
    """group_by "start" keeps samples whose start is clamped to 0 in one frame; "t" keeps them apart. wide, high: the frame, None for no limit.

    dwell: seconds for which a label keeps its last look; paired: boxes near exactly one other live track share its look.
    """

    max_gap: float = 1.0
    reach: float = 1.0
    alpha: float = 0.6
    alpha_size: float | None = None
    step: float = 0.1
    interpolate: float = 0.5
    min_hits: int = 1
    confirm_score: float | None = None
    time_safety: float = 0.3
    group_by: str = "start"
    wide: int | None = None
    high: int | None = None
    x_safety: float = 0.0
    y_safety: float = 0.0
    styles: tuple[Style, ...] = ()
    dwell: float = 0.0
    paired: bool = False
    paired_distance: float = 1.0
    paired_margin: float = 0.25
    paired_age: float = 1.0


IN = ("entity_id", "class_id", "segment", "t", "start", "stop", "x", "y", "w", "h", "score", "pos", "provisional", "cuts")
#: kind: box, interpolated, unconfirmed (a box of a track that wasn't confirmed), refused (a provisional box without a track), new and match (decisions, at
#: the box's place), contended and risky (a track that several boxes could continue). distance: to the track matched, or to the nearest other.
OUT = "kind string, entity_id long, class_id string, segment long, track long, t double, start double, stop double, x int, y int, w int, h int, score double, pos int, provisional boolean, style string, distance double, reason string, near_miss double, by_score boolean"
FIELDS = [c.split()[0] for c in OUT.split(", ")]
RISKY = 0.25


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of finite costs: most pairs, then least total. One row or column: its nearest only.

    Shortest augmenting paths over potentials; a forbidden pair costs more than any complete set of allowed ones.
    """
    n, m = cost.shape
    allowed = np.isfinite(cost)
    if not allowed.any():
        return []
    rows, cols = np.flatnonzero(allowed.any(axis=1)), np.flatnonzero(allowed.any(axis=0))
    if len(rows) == 1 or len(cols) == 1:
        k = int(np.where(allowed, cost, np.inf).argmin())
        return [divmod(k, m)]
    flip = n > m
    big = float(cost[allowed].max() + 1) * (min(n, m) + 1)
    c = np.where(allowed, cost, big)
    c = c.T if flip else c
    rows, cols = c.shape
    u, v, owner, prior = np.zeros(rows), np.zeros(cols), np.full(cols, -1), np.zeros(cols, int)
    for r in range(rows):
        dist, done = np.full(cols, np.inf), np.zeros(cols, bool)
        at, here, base = r, -1, 0.0
        while True:
            slack = base + c[at] - u[at] - v
            better = ~done & (slack < dist)
            dist[better], prior[better] = slack[better], here
            here = int(np.where(done, np.inf, dist).argmin())
            base = dist[here]
            done[here] = True
            if owner[here] < 0:
                break
            at = owner[here]
        for j in np.flatnonzero(done):
            v[j] += dist[j] - base
            if owner[j] >= 0:
                u[owner[j]] += base - dist[j]
        u[r] += base
        while here >= 0:
            before = prior[here]
            owner[here] = r if before < 0 else owner[before]
            here = before
    pairs = [(int(owner[j]), j) for j in range(cols) if owner[j] >= 0]
    pairs = [(j, i) for i, j in pairs] if flip else pairs
    return sorted((i, j) for i, j in pairs if allowed[i, j])


def safe_box(b: dict, s: Settings, style: Style | None) -> tuple[int, int, int, int]:
    """The box with a style's safety, or the label's, within the frame."""
    out = []
    for c, d, most, own, item in (("x", "w", s.wide, style and style.x_safety, s.x_safety), ("y", "h", s.high, style and style.y_safety, s.y_safety)):
        share = item if own is None else own
        corner = math.floor(max(0.0, b[c] - b[d] * share / 2)) if most is not None or share else b[c]
        size = b[d] * (1 + share)
        if most is not None:
            corner = min(corner, max(0, most - 1))
            size = min(most - corner, size)
        out.append((corner, max(1, math.ceil(size)) if most is not None or share else size))
    return out[0][0], out[1][0], out[0][1], out[1][1]


class Tracker:
    """Tracks of one segment, fed frame by frame; rows come out when their track is confirmed, dead or at the end."""

    def __init__(self, s: Settings, key: tuple, cuts: list[float]):
        self.s, self.key, self.cuts = s, key, cuts
        self.size_alpha = s.alpha / 3 if s.alpha_size is None else s.alpha_size
        self.live: list[dict] = []
        self.next = 0
        self.last: tuple[Style, float] | None = None
        self.out: list[dict] = []

    def across(self, earlier: float, later: float) -> bool:
        """Whether a cut lies in (earlier, later]."""
        k = bisect_right(self.cuts, earlier)
        return k < len(self.cuts) and self.cuts[k] <= later

    def row(self, kind: str, b: dict, **more) -> dict:
        return {"kind": kind, "t": b["t"], "start": b["start"], "stop": b["stop"], "score": b["score"], "pos": b["pos"], "provisional": b["provisional"]} | more

    def settle(self, k: dict, over: bool) -> None:
        """Give out the rows that a track has kept back, once it is confirmed or over."""
        by_hits = k["hits"] >= self.s.min_hits
        good = by_hits or self.s.confirm_score is not None and k["best"] >= self.s.confirm_score
        if not good and not over:
            return
        if by_hits and not k["done"]:
            k["done"] = True
        if by_hits or over:
            for r in k["rows"]:
                self.out.append(r | {"by_score": good and not by_hits} if good else r | {"kind": "unconfirmed"})
            k["rows"] = []

    def draw(self, track: int) -> Style | None:
        """One weighted draw for a track, the same in every run."""
        if not self.s.styles:
            return None
        u = int(hashlib.md5(f"{self.key[0]}/{self.key[1]}/{track}".encode()).hexdigest()[:8], 16) / 4294967296.0 * sum(x.weight for x in self.s.styles)
        for x in self.s.styles:
            u -= x.weight
            if u < 0:
                return x
        return self.s.styles[-1]

    def neighbour(self, x, y, w, h, start: float, t: float, but: dict | None = None) -> dict | None:
        """The one other live track near a box, if it is clear which."""
        s, near = self.s, []
        for n, k in enumerate(self.live):
            if k is but or start - k["stop"] > min(s.paired_age, s.max_gap) or self.across(k["t"], t):
                continue
            d = math.hypot(x + w / 2 - k["x"] - k["w"] / 2, y + h / 2 - k["y"] - k["h"] / 2)
            if d < s.paired_distance * max(k["w"], k["h"], w, h):
                near.append((d, n))
        near.sort()
        if not near:
            return None
        if len(near) == 1 or near[0][0] == 0 or (near[1][0] - near[0][0]) / max(near[1][0], 1e-9) >= s.paired_margin:
            return self.live[near[0][1]]
        return None

    def frame(self, boxes: list[dict]) -> None:
        s = self.s
        for k in self.live:
            if boxes[0]["start"] - k["stop"] > s.max_gap:
                self.settle(k, True)
        live = self.live = [k for k in self.live if boxes[0]["start"] - k["stop"] <= s.max_gap]
        for b in boxes:
            b["raw"] = {c: b[c] for c in "xywh"}
            b["x"], b["y"], b["w"], b["h"] = safe_box(b["raw"], s, None)
        near: list[tuple[float, int, int]] = []  # distance, box, track
        for i, k in enumerate(live):
            some = []
            for j, b in enumerate(boxes):
                if self.cuts and self.across(k["t"], b["t"]):
                    continue
                d = math.hypot(k["x"] + k["w"] / 2 - b["x"] - b["w"] / 2, k["y"] + k["h"] / 2 - b["y"] - b["h"] / 2)
                if d < s.reach * max(k["w"], k["h"], b["w"], b["h"]):
                    near.append((d, j, i))
                    some.append(d)
            if len(some) > 1:
                first, second = sorted(some)[:2]
                risky = bool(second) and (second - first) / second <= RISKY
                self.out.append(self.row("risky" if risky else "contended", boxes[0], track=k["id"], distance=first))
        if len({j for _, j, _ in near}) > 1 and len({i for *_, i in near}) > 1:
            cost = np.full((len(live), len(boxes)), np.inf)
            for d, j, i in near:
                cost[i, j] = d
            near = [(float(cost[i, j]), j, i) for i, j in assign(cost)]
        else:
            near = near and [min(near)]
        matched: dict[int, dict] = {}
        for d, j, i in sorted(near):
            matched[j] = live[i]
            self.go_on(live[i], boxes[j], d)
        if s.paired:
            self.sync(boxes, matched)
        for j, b in enumerate(boxes):
            if j not in matched:
                self.begin(b)
        for k in matched.values():
            self.settle(k, False)

    def go_on(self, k: dict, b: dict, distance: float) -> None:
        s = self.s
        self.out.append(self.row("match", b, track=k["id"], distance=distance))
        to = dict(zip("xywh", safe_box(b["raw"], s, k["style"])))
        gap = b["t"] - k["t"]
        if 1.5 * s.step < gap <= s.interpolate:  # from the last smoothed box to this one before smoothing
            steps = round(gap / s.step)
            for n in range(1, steps):
                f = n / steps
                t = k["t"] + f * gap
                mid = {c: int(k[c] + f * (to[c] - k[c])) for c in "xywh"}
                k["rows"].append(self.row("interpolated", b, track=k["id"], **mid) | {"t": t, "start": max(t - s.time_safety / 2, 0.0), "stop": t + s.time_safety / 2, "score": min(k["score"], b["score"]), "style": k["style"] and k["style"].name})
        new = {c: int(a * to[c] + (1 - a) * k[c]) for c, a in (("x", s.alpha), ("y", s.alpha), ("w", self.size_alpha), ("h", self.size_alpha))}
        for c, d, most in (("x", "w", s.wide), ("y", "h", s.high)):
            if most is not None:
                new[c] = max(0, min(new[c], most - 1))
                new[d] = max(1, min(new[d], most - new[c]))
        k.update(new, t=b["t"], stop=b["stop"], score=b["score"])
        if not b["provisional"]:
            k["hits"] += 1
            k["best"] = max(k["best"], b["score"])
        k["rows"].append(self.row("box", b, track=k["id"], style=k["style"] and k["style"].name, **new))

    def sync(self, boxes: list[dict], matched: dict[int, dict]) -> None:
        """Tracks of this frame that are each other's one neighbour take the older one's look."""
        s, place = self.s, {id(k): n for n, k in enumerate(self.live)}
        tracks = sorted(matched.values(), key=lambda k: place[id(k)])
        other = {id(k): self.neighbour(k["x"], k["y"], k["w"], k["h"], boxes[0]["start"], boxes[0]["t"], k) for k in tracks}
        synced: set[int] = set()
        for k in tracks:
            o = other[id(k)]
            if o is None or other.get(id(o)) is not k:
                continue
            low, high = sorted((k, o), key=lambda x: place[id(x)])
            if id(low) in synced or id(high) in synced or low["style"] == high["style"]:
                continue
            synced |= {id(low), id(high)}
            high["style"] = low["style"]
            if high["rows"]:
                high["rows"][-1]["style"] = low["style"] and low["style"].name

    def begin(self, b: dict) -> None:
        s = self.s
        if b["provisional"]:
            self.out.append(self.row("refused", b, **{c: int(b[c]) for c in "xywh"}))
            return
        pair = self.neighbour(b["x"], b["y"], b["w"], b["h"], b["start"], b["t"]) if s.paired else None
        if pair is not None:
            style = pair["style"]
        elif self.last is not None and b["t"] - self.last[1] < s.dwell:
            style = self.last[0]
        else:
            style = self.draw(self.next)
            self.last = (style, b["t"])
        new = {c: int(v) for c, v in zip("xywh", safe_box(b["raw"], s, style))}
        reason, distance, miss = self.why(new, b)
        self.out.append(self.row("new", b, track=self.next, distance=distance, reason=reason, near_miss=miss, style=style and style.name, **new))
        k = new | {"id": self.next, "hits": 1, "best": b["score"], "t": b["t"], "stop": b["stop"], "score": b["score"], "style": style, "rows": [], "done": False}
        k["rows"].append(self.row("box", b, track=self.next, style=style and style.name, **new))
        self.next += 1
        self.live.append(k)
        self.settle(k, False)

    def why(self, new: dict, b: dict) -> tuple[str, float | None, float | None]:
        """Why no live track went on with a box: by the nearest one (W25); and the nearest within 1.5 sizes not across a cut."""
        s, best, miss = self.s, None, None
        for k in self.live:
            d = math.hypot(new["x"] + new["w"] / 2 - k["x"] - k["w"] / 2, new["y"] + new["h"] / 2 - k["y"] - k["h"] / 2)
            size, cut = max(k["w"], k["h"], new["w"], new["h"]), self.across(k["t"], b["t"])
            if best is None or d < best[0]:
                best = d, b["start"] - k["stop"] > s.max_gap, d >= s.reach * size, cut
            if d < 1.5 * size and not cut and (miss is None or d < miss):
                miss = d
        if best is None:
            return "no-nearby-track", None, None
        d, late, far, cut = best
        return ("after-cut" if cut else "both-blocked" if far and late else "distance-blocked" if far else "gap-blocked" if late else "unexplained"), d, miss

    def end(self) -> None:
        for k in self.live:
            self.settle(k, True)
        self.live = []


def follow(rows: Iterator[dict], s: Settings) -> Iterator[list[dict]]:
    """Rows of the schema OUT from rows in order of (entity_id, class_id, segment, start, t, pos), some at a time."""
    for key, group in groupby(rows, key=lambda r: (r["entity_id"], r["class_id"], r["segment"])):
        tracker = None
        for _, frame in groupby(group, key=lambda r: r[s.group_by]):
            boxes = list(frame)
            if tracker is None:
                tracker = Tracker(s, key, boxes[0]["cuts"] or [])
            tracker.frame(boxes)
            if len(tracker.out) >= 4096:
                yield [dict(zip(FIELDS[1:4], key)) | r for r in tracker.out]
                tracker.out = []
        tracker.end()
        yield [dict(zip(FIELDS[1:4], key)) | r for r in tracker.out]


def segments(boxes: DataFrame, cuts: DataFrame | None) -> DataFrame:
    """Adds segment: how many cuts of the entity are at or before t (J7), and the cuts. cuts: (entity_id, cuts array), one row an entity."""
    none = F.array().cast("array<double>")
    if cuts is None:
        return boxes.withColumns({"segment": F.lit(0).cast("long"), "cuts": none})
    out = boxes.join(cuts, "entity_id", "left").withColumn("cuts", F.coalesce("cuts", none))
    return out.withColumn("segment", F.size(F.filter("cuts", lambda c: c <= F.col("t"))).cast("long"))


def tracking(boxes: DataFrame, settings: Settings = Settings(), cuts: DataFrame | None = None) -> DataFrame:
    """boxes: entity_id, class_id, t, start, stop, x, y, w, h, score, pos, provisional -> boxes and decisions, schema OUT."""
    s = settings
    need = segments(boxes, cuts)
    if s.styles:
        need = need.withColumn("segment", F.lit(0).cast("long"))
    else:
        # the cuts are in the segments; so are gaps that no track outlives
        order = W.partitionBy("entity_id", "class_id", "segment").orderBy("start", "t", "pos")
        apart = F.col("start") - F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1)) > s.max_gap
        part = F.sum(F.when(apart, 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0))
        need = need.withColumns({"cuts": F.array().cast("array<double>"), "_part": part}).withColumn("segment", F.col("segment") * 1_000_000_000 + F.col("_part"))
    key = ["entity_id", "class_id", "segment"]
    need = need.select(*IN).repartition(*key).sortWithinPartitions(*key, "start", "t", "pos")
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(boxes.sparkSession.createDataFrame([], OUT).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[dict] = []
        for part in follow((r for b in batches for r in b.to_pylist()), s):
            some += part
            if len(some) >= 4096:
                yield pa.RecordBatch.from_pylist(some, arrow)
                some = []
        if some:
            yield pa.RecordBatch.from_pylist(some, arrow)

    return need.mapInArrow(run, OUT)


def track(boxes: DataFrame, settings: Settings = Settings(), cuts: DataFrame | None = None) -> DataFrame:
    """The boxes of confirmed tracks, those filled in too."""
    out = tracking(boxes, settings, cuts).where(F.col("kind").isin("box", "interpolated"))
    return out.withColumn("interpolated", F.col("kind") == "interpolated").drop("kind", "distance", "reason", "near_miss")


TRACK = ["entity_id", "class_id", "segment", "track"]


def decisions(found: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of what a tracking run decided (A22, A25): found has schema OUT."""
    n = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    return found.groupBy(*keys).agg(n("match").alias("matches"), n("new").alias("new_tracks"), n("contended", "risky").alias("contention"), n("risky").alias("risky"), n("box", "interpolated").alias("rendered"), n("interpolated").alias("interpolated"), n("refused").alias("dropped_provisional"), n("unconfirmed").alias("dropped_unconfirmed"))


def resets(found: DataFrame) -> DataFrame:
    """New tracks by the reason that no live track went on (W25), and how many had a near miss."""
    return found.where("kind = 'new'").groupBy("class_id", "reason").agg(F.count("*").alias("n"), F.count("near_miss").alias("near_misses"))


def jitter(tracks: DataFrame) -> DataFrame:
    """Distance of a track's centre from its place before."""
    order = W.partitionBy(*TRACK).orderBy("t", "pos")
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    return tracks.withColumns({"_cx": cx, "_cy": cy}).withColumn("moved", F.sqrt(F.pow(F.col("_cx") - F.lag("_cx").over(order), 2) + F.pow(F.col("_cy") - F.lag("_cy").over(order), 2))).drop("_cx", "_cy")


def stabilised(tracks: DataFrame, keys: list[str], window: float, wide: float | None = None, high: float | None = None) -> DataFrame:
    """Largest size within +-window of each sample, about the same centre, within the frame if given (W17). window 0: of the whole track."""
    over = ", ".join(f"`{k}`" for k in keys)
    frame = "" if window == 0 else f" ORDER BY t RANGE BETWEEN {window}D PRECEDING AND {window}D FOLLOWING"  # the API takes whole numbers only
    out = tracks.withColumns({c: F.expr(f"max({n}) OVER (PARTITION BY {over}{frame})") for c, n in (("sw", "w"), ("sh", "h"))})

    def corner(c: str, n: str, m: str, most: float | None) -> Column:
        at = F.col(c) + (F.col(n) - F.col(m)) / 2
        return at if most is None else F.greatest(F.lit(0.0), F.least(at, F.lit(float(most)) - F.col(m)))

    return out.withColumns({"sx": corner("x", "w", "sw", wide), "sy": corner("y", "h", "sh", high)})


def resampled(samples: DataFrame, keys: list[str], rate: float, max_span: float, value: str) -> DataFrame:
    """Linear interpolation to a grid of `rate` a second between samples at most max_span apart, never beyond; half-even."""
    order = W.partitionBy(*keys).orderBy("t")
    pairs = samples.withColumns({"_t": F.lead("t").over(order), "_v": F.lead(value).over(order)}).where((F.col("_t") - F.col("t") <= max_span) & (F.col("_t") > F.col("t")))
    first, last = F.ceil(F.col("t") * rate).cast("long"), (F.ceil(F.col("_t") * rate) - 1).cast("long")
    grid = pairs.where(first <= last).select(*keys, "t", "_t", value, "_v", F.explode(F.sequence(first, last)).alias("i"))
    f = (F.col("i") / rate - F.col("t")) / (F.col("_t") - F.col("t"))
    return grid.select(*keys, "i", F.bround(F.col(value) + (F.col("_v") - F.col(value)) * f).cast("long").alias("v"))


def collapsed(live: DataFrame, now: str, keys: list[str], growth: float = 1.15) -> DataFrame:
    """Of a track's samples live at one instant the latest not after it, where their union is hardly larger than the largest; else all."""
    g = W.partitionBy(*keys, now)
    area = F.col("w") * F.col("h")
    union = (F.max(F.col("x") + F.col("w")).over(g) - F.min("x").over(g)) * (F.max(F.col("y") + F.col("h")).over(g) - F.min("y").over(g))
    d = live.withColumns({"_u": union, "_l": F.max(area).over(g)}).withColumn("_one", (F.col("_l") > 0) & (F.col("_u") <= F.col("_l") * growth))
    first = g.orderBy((F.col("t") > F.col(now)).cast("int"), F.desc("t"), "pos")
    return d.withColumn("_r", F.row_number().over(first)).where(~F.col("_one") | (F.col("_r") == 1)).drop("_u", "_l", "_one", "_r")


def merged_boxes(boxes: DataFrame, keys: list[str], strategy: str, extend: float = 0.0, wide: float | None = None) -> DataFrame:
    """Boxes of one label and look at one instant, by the look's strategy (X7): none, single-pass (each takes in the first segment that it touches, in order of
    pos) or span (exactly two become one, drawn out towards the frame's sides). A group is an instant's boxes."""
    cols = [F.col(c).cast("double").alias(c) for c in "xywh"]
    if strategy not in ("single-pass", "span"):
        return boxes.select(*keys, *cols)
    g = boxes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", *cols))).alias("all"))
    if strategy == "span":
        x0, x1 = F.array_min("all.x"), F.array_max(F.transform("all", lambda b: b["x"] + b["w"]))
        y0, y1 = F.array_min("all.y"), F.array_max(F.transform("all", lambda b: b["y"] + b["h"]))
        x0, x1 = (x0 - x0 * extend, x1 + (wide - x1) * extend) if extend and wide else (x0, x1)
        whole = lambda c: c.cast("int").cast("double")
        one = F.array(F.struct(F.lit(0).alias("pos"), whole(x0).alias("x"), whole(y0).alias("y"), F.greatest(F.lit(1.0), whole(x1 - x0)).alias("w"), F.greatest(F.lit(1.0), whole(y1 - y0)).alias("h")))
        fields = "array<struct<pos:int,x:double,y:double,w:double,h:double>>"
        return g.select(*keys, F.explode(F.when(F.size("all") == 2, one.cast(fields)).otherwise(F.col("all").cast(fields))).alias("b")).select(*keys, "b.x", "b.y", "b.w", "b.h")
    meets = "k.x <= r.x + r.w and r.x <= k.x + k.w and k.y <= r.y + r.h and r.y <= k.y + k.h"
    joint = "named_struct('pos', k.pos, 'x', least(k.x, r.x), 'y', least(k.y, r.y), 'w', greatest(k.x + k.w, r.x + r.w) - least(k.x, r.x), 'h', greatest(k.y + k.h, r.y + r.h) - least(k.y, r.y))"
    at = f"array_position(transform(acc, k -> {meets}), true)"
    step = f"if({at} = 0, concat(acc, array(r)), transform(acc, (k, i) -> if(i = {at} - 1, {joint}, k)))"
    done = F.expr(f"aggregate(all, slice(all, 1, 0), (acc, r) -> {step})")
    return g.select(*keys, F.explode(done).alias("b")).select(*keys, "b.x", "b.y", "b.w", "b.h")


def cut_bursts_merged(cuts: Column, window: float, max_span: float | None = None, keep: str = "last") -> Column:
    """A sorted array of cuts with each burst (gaps below the window) that is short enough as its first or last cut (W5). Folded inside the JVM."""
    if keep not in ("last", "first"):
        raise ValueError("keep must be 'last' or 'first'")
    empty = F.array().cast("array<array<double>>")
    apart = lambda acc, c: c - F.element_at(F.element_at(acc, -1), -1) >= window - 1e-6
    runs = F.aggregate(F.array_sort(cuts), empty, lambda acc, c: F.when(F.size(acc) == 0, F.array(F.array(c))).when(apart(acc, c), F.concat(acc, F.array(F.array(c)))).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.array(c))))))
    one = lambda r: F.array(F.element_at(r, -1 if keep == "last" else 1))
    long = (lambda r: F.lit(False)) if max_span is None else (lambda r: F.element_at(r, -1) - F.element_at(r, 1) > max_span + 1e-6)
    return F.flatten(F.transform(runs, lambda r: F.when(long(r), r).otherwise(one(r))))


def unioned(parts: list[DataFrame]) -> DataFrame:
    """Detections of several sizes or files as one."""
    return reduce(DataFrame.unionByName, parts)
