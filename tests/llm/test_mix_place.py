"""Weights of the mix over a long schedule."""

from collections import Counter
from fractions import Fraction

from trackloom.llm import mixing


def test_given_weights_long():
    weights = {"a": 10.0**0.5, "b": 3.0**0.5, "c": 1.0, "d": 0.00002**0.5}
    total, n, done = sum(map(Fraction, weights.values())), 20_000, Counter()
    for t, (s, k, release, due, slot) in enumerate(mixing.schedule(weights, dict.fromkeys(weights, n)), 1):
        if t > n:
            break
        assert slot == t - 1 and release <= slot < due and k == done[s]
        done[s] += 1
        assert all(abs(done[x] - t * Fraction(w) / total) < 1 for x, w in weights.items())
    last = list(mixing.schedule({"a": 1, "z": 0}, {"a": 3, "z": 2}))
    assert [x[0] for x in last] == list("aaazz") and [x[4] for x in last] == list(range(5))


def test_given_weights_rows(spark):
    docs = spark.createDataFrame([(i, "x" * 99, "ab"[i % 2]) for i in range(4000)], "doc_id long, text string, source string")
    got = {(r["source"], r["block"]): r["slot"] for r in mixing.mix_sources(docs, {"a": 0.9983, "b": 0.0017}, block_bytes=100).collect()}
    slots = sorted(got.values())
    assert len(slots) == len(set(slots)) == 4000
    for (s, k), slot in got.items():
        w = Fraction(0.9983 if s == "a" else 0.0017) / (Fraction(0.9983) + Fraction(0.0017))
        assert k // w <= slot < -(-(k + 1) // w)
