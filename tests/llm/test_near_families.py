"""The pipeline's near-duplicate stage on a large family of edited copies, most of them too far apart: against all pairs, and how many pairs its joins make."""

import random

import numpy as np
import pytest

from trackloom.llm import simhash


def joined_rows(spark, since: int) -> int:
    """The most rows that a join made in the queries from the since-th on."""
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    for run in (runs.apply(i).executionId() for i in range(since, runs.size())):
        said, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
                if "Join" in node.name() and m.name() == "number of output rows" and said.contains(m.accumulatorId()):
                    most = max(most, int(said.apply(m.accumulatorId()).replace(",", "")))
    return most


@pytest.mark.parametrize("few", [2, 32])
def test_family(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "FEW", few)
    called = []
    monkeypatch.setattr(simhash, "links", lambda fps, *more, found=simhash.links: called.append(1) or found(fps, *more))
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    base, texts = [word() for _ in range(150)], []
    for k in range(400):
        if k % 9 == 5:  # a copy of a copy
            t = list(texts[r.randrange(k)])
        else:
            t = list(base)
        for _ in range(r.choice((0, 1, 2, 4, 5, 6, 7, 8))):
            at = r.randrange(len(t))
            t[at : at + 1] = r.choice(([word()], [], [base[0]], [word(), word()]))
        texts.append(t)
    sets = [set(simhash.shingles(" ".join(t), 5)) for t in texts]
    group = list(range(len(sets)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                group[b] = a
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    before = spark._jsparkSession.sharedState().statusStore().executionsList().size()
    got = sorted(x["doc_id"] for x in simhash.drop_near_duplicates(df).collect())
    assert got == [i for i in range(len(sets)) if find(i) == i] and 50 < len(got) < 350
    assert called, "fingerprints take no part"
    assert joined_rows(spark, before) < 60_000


def test_packed_counts():
    for most in (3, 255, 256, 65_535):
        counts = np.array([0, 1, most, 2], np.uint16)
        assert simhash.unpacked(simhash.packed(counts)).tolist() == counts.tolist()
    assert len(simhash.packed(np.zeros(8, np.uint16))) == 9
