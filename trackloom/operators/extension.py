"""What users plug in: detectors and segmenters, scenarios to compare, tuning stages and per-configuration runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..sources.detections import DETECTION
from . import decide


class Adapter(Protocol):
    """A detector or segmenter (D1, D2): made once a worker task, given samples in batches of any size, and known by settings that change its results."""

    def load(self) -> object: ...

    def detect(self, model: object, samples: pd.DataFrame) -> pd.DataFrame: ...

    def identity(self) -> dict: ...


_ADAPTERS: dict[str, Adapter] = {}


def register(name: str, adapter: Adapter) -> None:
    if name in _ADAPTERS:
        raise ValueError(f"there is an adapter {name} already")
    _ADAPTERS[name] = adapter


def adapter(name: str) -> Adapter:
    if name not in _ADAPTERS:
        raise ValueError(f"no adapter {name}; there are {', '.join(sorted(_ADAPTERS)) or 'none'}")
    return _ADAPTERS[name]


def detect(samples: DataFrame, name: str, batch: int = 4, schema: str | None = None) -> DataFrame:
    """Samples through an adapter, `batch` at a time; the result doesn't depend on the batch where the adapter judges samples one by one."""
    a = adapter(name)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = a.load()
        for f in frames:
            for k in range(0, len(f), batch):
                yield a.detect(model, f.iloc[k : k + batch])

    return samples.mapInPandas(run, schema or DETECTION)


@dataclass(frozen=True)
class Scenario:
    """One side of a comparison (D4): how detections are prepared and tracked. cut_transform changes the cuts that tracking stops at."""

    name: str
    prepare: Callable[[DataFrame], DataFrame]
    track: Callable[[DataFrame, DataFrame | None], DataFrame]
    cut_transform: Callable[[DataFrame], DataFrame] | None = None

    def run(self, det: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
        if cuts is not None and self.cut_transform is not None:
            cuts = self.cut_transform(cuts)
        return self.track(self.prepare(det), cuts).withColumn("scenario", F.lit(self.name))


def compare(scenarios: list[Scenario], det: DataFrame, frame: float, labels: list[str], cuts: DataFrame | None = None) -> DataFrame:
    """Replay metrics of each scenario over the same detections."""
    parts = [decide.replay_metrics(s.run(det, cuts), det, frame, labels).withColumn("scenario", F.lit(s.name)) for s in scenarios]
    return reduce(DataFrame.unionByName, parts)


@dataclass
class TuningStage:
    """A setting with candidate values (D5): each is measured, rows are scored against the baseline, and a decision taken over all configurations."""

    key: str
    baseline: float
    values: tuple[float, ...]
    measure: Callable[[float], DataFrame]  # (configuration, new_tracks, risky, coverage_loss)
    limits: dict = field(default_factory=dict)

    def rows(self) -> DataFrame:
        each = [self.measure(v).withColumns({"value": F.lit(float(v)), "is_baseline": F.lit(v == self.baseline)}) for v in (self.baseline, *[v for v in self.values if v != self.baseline])]
        return reduce(DataFrame.unionByName, each)

    def scored(self) -> DataFrame:
        return decide.priced(self.rows(), ["configuration"], **self.limits).withColumn("key", F.lit(self.key))

    def decision(self) -> DataFrame:
        return decide.chosen_value(self.scored(), ["key"], "configuration")


def per_configuration(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, list[str], str], DataFrame]:
    """f for each configuration on its own rows, with the configuration beside each result."""

    def run(df: DataFrame, configurations: list[str], column: str = "configuration") -> DataFrame:
        return reduce(DataFrame.unionByName, [f(df.where(F.col(column) == c)).withColumn(column, F.lit(c)) for c in configurations])

    return run
