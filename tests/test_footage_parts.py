"""The same footage among many signatures that all differ: dealt to parts, and with the pairs of the rule taken one by one."""

import random

import pytest
from pyspark.sql import functions as F

from trackloom.operators import footage, stats

SCHEMA = "entity_id long, duration double, seconds map<string,double>, mixed double, timeline array<double>"


def signatures(n, seed):
    """Families of near copies: shifted, stretched and changed at the limits of the rule."""
    r = random.Random(seed)
    rows = []
    for k in range(n):
        if k % 4 == 0:
            duration, labels = r.choice([1.0, 90.0, 100.0, 640.0, 700.0]) * r.uniform(0.96, 1.04), r.sample("abcd", r.randint(1, 4))
            seconds = {x: r.choice([0.0, 15.0, 33.0, 200.0]) + r.randint(0, 20) / 10 for x in labels}
            line = [r.choice([0.0, 0.0, 0.1, 0.2, 1.0, 3.3]) for _ in range(r.choice([0, 1, 5, int(duration / 10) + 1, int(duration / 10) + 1]))]
            mixed = r.choice([0.0, 1.0, 50.0])
        near = list(line)
        for _ in range(r.randint(0, 3)):
            if near:
                near[r.randrange(len(near))] += r.choice([0.1, 0.1, 0.5])
        cut = r.choice([0, 0, 0, 1, 2])
        some = {x: v + r.choice([0.0, 0.0, 1.9, 2.0, 2.1, v * 0.06]) for x, v in seconds.items()}
        if r.random() < 0.2:
            some["e"] = r.choice([2.0, 2.1])
        rows.append((k, duration * r.choice([1.0, 1.0, 1.01, 1.02, 1 / 0.98]), some, mixed + r.choice([0.0, 2.0, 2.5]), near[cut:] if r.random() < 0.5 else [0.0] * cut + near))
    return rows


def by_rule(s):
    """The rule over all pairs."""
    wide = lambda p: s.select(*[F.col(c).alias(f"{p}{c}") for c in s.columns])
    return {(x["a_entity_id"], x["b_entity_id"]) for x in wide("a_").crossJoin(wide("b_")).where("a_entity_id < b_entity_id").where(stats.same_content("a_", "b_")).select("a_entity_id", "b_entity_id").collect()}


@pytest.mark.parametrize("rows", [7, 8192])
def test_parts(spark, monkeypatch, rows):
    monkeypatch.setattr(stats, "PART_ROWS", rows)
    s = spark.createDataFrame(signatures(280, rows), SCHEMA)
    want = by_rule(s)
    got = [(x["a"], x["b"]) for x in stats.same_footage(s).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_columns_come_along(spark):
    s = spark.createDataFrame([(k, 100.0, {"a": 40.0}, 0.0, [1.0, 2.0, 3.0 + k / 100], f"n{k}") for k in (2, 1)], SCHEMA + ", name string")
    assert [x.asDict() for x in stats.same_footage(s).collect()] == [{"a": 1, "b": 2, "a_name": "n1", "b_name": "n2"}]


def test_differing_signatures_are_told_apart_by_sums(spark, monkeypatch):
    """Only few of the pairs of differing signatures have their timelines compared value by value."""
    r = random.Random(4)
    import pyarrow as pa

    rows = [(k, 700.0, [("a", 40.0)], 0.0, [r.choice([0.0, 0.0, 0.1, 0.2]) for _ in range(70)], False) for k in range(400)]
    kind = pa.schema([("_key", pa.int64()), ("duration", pa.float64()), ("seconds", pa.map_(pa.string(), pa.float64())), ("mixed", pa.float64()), ("timeline", pa.list_(pa.float64())), ("_right", pa.bool_())])
    table = pa.Table.from_pylist([dict(zip(kind.names, x)) for x in rows], kind)
    compared = []
    monkeypatch.setattr(footage, "near", lambda *a, found=footage.near: compared.append(len(a[2])) or found(*a))
    assert list(footage.pairs(table, True, ["_key"])) == [] and sum(compared) < 800
