"""Box algebra as column expressions; everything stays in whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def area(b: str = "") -> Column:
    return F.col(f"{b}w") * F.col(f"{b}h")


def intersection(a: str, b: str) -> Column:
    """Shared area of boxes whose columns have these prefixes; 0 where they don't overlap."""
    c = lambda p, n: F.col(f"{p}{n}")
    wide = F.least(c(a, "x") + c(a, "w"), c(b, "x") + c(b, "w")) - F.greatest(c(a, "x"), c(b, "x"))
    high = F.least(c(a, "y") + c(a, "h"), c(b, "y") + c(b, "h")) - F.greatest(c(a, "y"), c(b, "y"))
    return F.when((wide > 0) & (high > 0), wide * high).otherwise(F.lit(0.0))


def iou(a: str, b: str) -> Column:
    """Intersection over union, 0 without overlap or area."""
    shared = intersection(a, b)
    return F.when(shared > 0, shared / (area(a) + area(b) - shared)).otherwise(F.lit(0.0))


def shared_of(a: Column, b: Column) -> Column:
    """intersection() of two structs."""
    wide = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    high = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def iou_of(a: Column, b: Column) -> Column:
    """iou() of two structs."""
    shared = shared_of(a, b)
    return F.when(shared > 0, shared / (a["w"] * a["h"] + b["w"] * b["h"] - shared)).otherwise(F.lit(0.0))


def share_of(a: Column, b: Column) -> Column:
    """covered_share() of two structs."""
    return F.when(a["w"] * a["h"] > 0, shared_of(a, b) / (a["w"] * a["h"])).otherwise(F.lit(0.0))


def covered_share(a: str, b: str) -> Column:
    """Share of box a that b covers."""
    return F.when(area(a) > 0, intersection(a, b) / area(a)).otherwise(F.lit(0.0))


def touches(a: str, b: str, strict: bool = False) -> Column:
    """Whether boxes meet; edges count unless strict."""
    c = lambda p, n: F.col(f"{p}{n}")
    pairs = [(c(a, "x"), c(b, "x") + c(b, "w")), (c(b, "x"), c(a, "x") + c(a, "w")), (c(a, "y"), c(b, "y") + c(b, "h")), (c(b, "y"), c(a, "y") + c(a, "h"))]
    out = F.lit(True)
    for lo, hi in pairs:
        out = out & ((lo < hi) if strict else (lo <= hi))
    return out


def centre_distance(a: str, b: str) -> Column:
    """Euclid of the centres."""
    c = lambda p, n, s: F.col(f"{p}{n}") + F.col(f"{p}{s}") / 2
    return F.sqrt(F.pow(c(a, "x", "w") - c(b, "x", "w"), 2) + F.pow(c(a, "y", "h") - c(b, "y", "h"), 2))


def padded(safety: float, wide: float, high: float, safety_y: float | None = None) -> dict[str, Column]:
    """Integer box grown by half the safety of its size on each side (P5, P15): the corner is clamped to the frame and floored before the size is clamped and rounded up, 1 x 1 at least."""
    out = {}
    for c, s, most, share in (("x", "w", wide, safety), ("y", "h", high, safety if safety_y is None else safety_y)):
        corner = F.least(F.floor(F.greatest(F.lit(0.0), F.col(c) - F.col(s) * share / 2)), F.lit(max(0, int(most) - 1)))
        out[f"p{c}"] = corner.cast("int")
        out[f"p{s}"] = F.greatest(F.lit(1), F.ceil(F.least(F.lit(float(most)) - corner, F.col(s) * (1 + share)))).cast("int")
    return out


def aspect() -> Column:
    """Width by height, 0 without height."""
    return F.when(F.col("h") != 0, F.try_divide(F.col("w"), F.col("h"))).otherwise(F.lit(0.0))


def geometry_reason(frame_area: float, least: float | None, most: float | None, tallest: float | None, widest: float | None) -> Column:
    """First violated bound of small, large, tall, wide; null if none (P8). tallest is the least w/h, widest the largest."""
    share = area() / max(1.0, float(frame_area))
    out = F.lit(None).cast("string")
    for bound, name, bad in ((widest, "too_wide", lambda: aspect() > widest), (tallest, "too_tall", lambda: aspect() < tallest), (most, "too_large", lambda: share > most), (least, "too_small", lambda: share < least)):
        if bound is not None:
            out = F.when(bad(), name).otherwise(out)
    return out


#: What is done about a least and a greatest bound, the bound of each reason, and the actions there are.
GEOMETRY_DEFAULT = {"min": "drop", "max": "clamp"}
GEOMETRY_BOUND = {"too_small": "min", "too_large": "max", "too_tall": "min", "too_wide": "max"}
GEOMETRY_ACTIONS = ("drop", "clamp", "flag")


def geometry_action(reason: Column, action: str | dict[str, str] | None = None) -> Column:
    """keep, or what is done about a reason (P9): one action for all, or one for each kind of bound; what isn't known drops."""
    out = F.lit("keep")
    for name, bound in GEOMETRY_BOUND.items():
        act = action if isinstance(action, str) else (action or {}).get(bound, GEOMETRY_DEFAULT[bound])
        out = F.when(reason == name, act if act in GEOMETRY_ACTIONS else "drop").otherwise(out)
    return out


def clamped(reason: Column, wide: float, high: float, most: float, widest: float) -> dict[str, Column]:
    """Boxes too large or too wide, shrunk about their centre, at least 1 x 1 and within the frame; others as they are (P10)."""
    large, broad = reason == "too_large", reason == "too_wide"
    k = F.when(area() > 0, F.sqrt(F.try_divide(F.lit(most * max(1.0, wide * high)), area()))).otherwise(F.lit(1.0))
    sides = {"x": ("w", wide, F.when(large, F.col("w") * k).otherwise(F.col("h") * widest)), "y": ("h", high, F.when(large, F.col("h") * k).otherwise(F.col("h")))}
    out = {}
    for c, (s, frame, size) in sides.items():
        size = F.greatest(F.lit(1.0), F.least(size, F.lit(float(frame))))
        corner = F.greatest(F.lit(0.0), F.least(F.col(c) + F.col(s) / 2 - size / 2, F.lit(float(frame)) - size))
        touched = F.coalesce(large | broad, F.lit(False))
        out[f"c{c}"] = F.when(touched, corner).otherwise(F.col(c))
        out[f"c{s}"] = F.when(touched, size).otherwise(F.col(s))
    return out


def strength_scale(kind: Column, frame: Column) -> Column:
    """Style strength by what it is relative to."""
    return F.when(kind == "feature", F.least("w", "h") / 100).when(kind == "image", frame / 1000).otherwise(F.lit(1.0))


def settled(*tiers: str) -> Column:
    """The value of the most specific tier that has one."""
    return F.coalesce(*[F.col(t) for t in tiers])


def time_key(t: str = "t", places: int = 3) -> Column:
    return F.bround(t, places)


def frame_of(df, keys: list[str]):
    """keys, wide, high: the extent of each group's boxes, 1 at least."""
    return df.groupBy(*keys).agg(F.greatest(F.max(F.col("x") + F.col("w")), F.lit(1.0)).alias("wide"), F.greatest(F.max(F.col("y") + F.col("h")), F.lit(1.0)).alias("high"))


def style_order(kind: Column, strength: Column, colour: Column) -> Column:
    """A number that puts like styles side by side (P17). colour: the sum of three bytes."""
    blur = 1 + 1 / F.greatest(F.coalesce(strength, F.lit(20.0)), F.lit(1.0))
    bar = 2 + 1 / (2 + 255 * 3 - F.coalesce(colour, F.lit(0.0)))
    return F.when(kind == "blur", blur).when(kind == "bar", bar).when(kind == "pixel", 3 + F.coalesce(strength, F.lit(10.0))).when(kind == "sticker", 4.0).when(kind == "debug", 99.0).otherwise(50.0)


def style_key(style: Column) -> Column:
    """Equal for styles (maps) of equal entries, whatever their order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(style))))


def remapped(df, labels: list[str], index: str = "class_index"):
    """df with class_id of its model's class index; rows of an unknown index go."""
    names = F.array(*[F.lit(x) for x in labels])
    return df.where(F.col(index).between(0, len(labels) - 1)).withColumn("class_id", F.element_at(names, F.col(index).cast("int") + 1))


def absolute_cuts(cuts: Column, offset: Column) -> Column:
    """Cuts of a scan that began at offset on the source's own axis; null stays null."""
    return F.when(F.coalesce(offset, F.lit(0.0)) == 0, cuts).otherwise(F.transform(cuts, lambda c: F.bround(c + offset, 3)))


def scanned_window(duration: Column, offset: Column, most: Column) -> Column:
    """Seconds that a scan covered; null if the duration isn't known or nothing is left."""
    left = F.greatest(F.lit(0.0), duration - F.coalesce(offset, F.lit(0.0)))
    left = F.when(F.coalesce(most, F.lit(0.0)) > 0, F.least(left, most)).otherwise(left)
    return F.when((duration > 0) & (left > 0), left)
