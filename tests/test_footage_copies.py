"""Copies of the same footage: counted as pairs are, with equal signatures paired once."""

import random
from collections import Counter

from trackloom.operators import stats


def test_footage_copies(spark, monkeypatch):
    r = random.Random(2)
    rows = []
    for k in range(40):
        line = [r.choice([0.0, 1.0, 2.0, 3.0]) for _ in range(r.randint(0, 6))]
        one = (r.choice([98.0, 99.0, 100.0]), {"a": r.choice([10.0, 40.0, 41.0]), "b": 0.0}, 0.0, r.choice([line, [1.0, 2.0, 3.0], [1.0, 2.0, 3.1], [], [0.0, 0.0]]))
        rows += [(10 * k + i, *one) for i in range(r.randint(1, 4))]
    s = spark.createDataFrame(rows, "entity_id long, duration double, seconds map<string,double>, mixed double, timeline array<double>")
    want = Counter(x for p in stats.same_footage(s).collect() for x in (p["a"], p["b"]))
    paired = []
    monkeypatch.setattr(stats, "same_footage", lambda df, key, found=stats.same_footage: paired.append(df.count()) or found(df, key))
    got = {x["entity_id"]: x["copies"] for x in stats.footage_copies(s).collect()}
    assert got == {x[0]: want[x[0]] for x in rows} and max(got.values()) > 5 and 0 in got.values()
    assert paired[0] < len(rows) * 0.6
