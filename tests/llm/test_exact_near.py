"""The pipeline's near-duplicate stage against all pairs, on copies near the limit."""

import random

from trackloom.llm import simhash


def test_near_limit(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    texts, common = [], [word() for _ in range(30)]
    for k in range(60):
        base = [word() for _ in range(r.randint(80, 120))]
        n = len(base)
        cut, swap = base[: int(n * 0.82)], list(base)
        swap[n // 2] = word()
        texts += [base, base + [word() for _ in range(int(n * (0.18, 0.23, 0.28)[k % 3]))], cut, swap]
        texts += [common + [word() for _ in range(r.randint(2, 40))]]
    hub = [word() for _ in range(100)]
    texts += [hub[:k] + [word()] + hub[k + 1 :] for k in range(0, 100, 4)] + [[], ["one"], ["one"], ["One"]]
    r.shuffle(texts)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, None), (901, " \n")], "doc_id long, text string")
    sets = [set(simhash.shingles(" ".join(t), 5)) for t in texts] + [set(), set()]
    ids = [*range(len(texts)), 900, 901]
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
    want = {ids[i] for i in range(len(sets)) if find(i) == i}
    got = [x["doc_id"] for x in simhash.drop_near_duplicates(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
