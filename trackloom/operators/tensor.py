"""Array and tensor operators: anchor decoding, non-maximum suppression, histogram distance and cut detection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .stages import _SHARED, greedy


def decode_anchors(df: DataFrame, classes: int, floor: float, scale: float, wide: float, high: float) -> DataFrame:
    """df (image, tensor: array of 4 + classes rows of anchors, centre form) -> one row per anchor over the floor, as corner boxes clipped to the picture."""

    def run(batches):
        for pdf in batches:
            out = []
            for image, rows in zip(pdf["image"], pdf["tensor"]):
                t = np.array([np.asarray(r, float) for r in rows])
                best = t[4 : 4 + classes].argmax(axis=0)
                score = t[4 : 4 + classes].max(axis=0)
                cx, cy, w, h = t[:4] * scale
                x0, y0, x1, y1 = np.clip(cx - w / 2, 0, wide), np.clip(cy - h / 2, 0, high), np.clip(cx + w / 2, 0, wide), np.clip(cy + h / 2, 0, high)
                ok = (score > floor) & (x1 > x0) & (y1 > y0)
                out.append(pd.DataFrame({"image": image, "pos": np.flatnonzero(ok), "class_index": best[ok], "score": score[ok], "x": x0[ok], "y": y0[ok], "w": (x1 - x0)[ok], "h": (y1 - y0)[ok]}))
            yield pd.concat(out) if out else pd.DataFrame(columns=["image", "pos", "class_index", "score", "x", "y", "w", "h"])

    return df.select("image", "tensor").mapInPandas(run, "image long, pos int, class_index int, score double, x double, y double, w double, h double")


def nms(df: DataFrame, keys: list[str], max_iou: float) -> DataFrame:
    """Greedy: a row falls to a kept row of its group with a higher score (ties: smaller pos) and IoU over max_iou."""
    return greedy(df, keys, f"{_SHARED} > {max_iou} * (k.w * k.h + r.w * r.h - {_SHARED})")


def normalised(hist: Column) -> Column:
    """Absolute values that sum to 1."""
    a = F.transform(hist, lambda x: F.abs(x.cast("double")))
    return F.transform(a, lambda x: x / F.aggregate(a, F.lit(0.0), lambda p, q: p + q))


def bhattacharyya(a: Column, b: Column) -> Column:
    """Distance of two normalised histograms."""
    shared = F.aggregate(F.zip_with(a, b, lambda x, y: F.sqrt(x * y)), F.lit(0.0), lambda p, q: p + q)
    return F.sqrt(F.greatest(1 - shared, F.lit(0.0)))


def cuts(samples: DataFrame, threshold: float, key: str = "entity_id", order: str = "t", hist: str = "hist") -> DataFrame:
    """Samples at least the threshold from both samples before, whose successor is still that far from the state before the cut, two samples back; a last one needs no
    successor, and the first two are no cuts (W6)."""
    w = W.partitionBy(key).orderBy(order)
    s = samples.withColumns({"_p": F.lag(hist).over(w), "_pp": F.lag(hist, 2).over(w), "_n": F.lead(hist).over(w)})
    far = lambda a, b: bhattacharyya(F.col(a), F.col(b)) >= threshold
    return s.where(F.col("_pp").isNotNull() & far(hist, "_p") & far(hist, "_pp") & (F.col("_n").isNull() | far("_n", "_pp"))).drop("_p", "_pp", "_n")


def faded(a: Column, b: Column, share: Column) -> Column:
    """Two frames of equal size (arrays) mixed: share of the second."""
    return F.zip_with(a, b, lambda x, y: x * (1 - share) + y * share)


def decode_masks(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """df (image, person, coefficients, prototypes: array of planes of height x width, high, wide) -> bits (array of 0 and 1, by row) of each person's mask.

    A mask is 1 where the logistic of the weighted sum of prototypes is over the threshold."""
    planes = F.transform(F.arrays_zip("coefficients", "prototypes"), lambda p: F.transform(p["prototypes"], lambda v: v * p["coefficients"]))
    zero = F.transform(F.element_at("prototypes", 1), lambda v: F.lit(0.0))
    total = F.aggregate(planes, zero, lambda acc, p: F.zip_with(acc, p, lambda x, y: x + y))
    return df.select("image", "person", "high", "wide", F.transform(total, lambda v: (1 / (1 + F.exp(-v)) > threshold).cast("int")).alias("bits"))
