"""Toxicity by a subsequence string kernel over sentences, Nyström landmarks and a linear support vector machine.

The kernel of two strings counts common subsequences of LENGTH letters, each weighted by DECAY to the power of the letters it
spans in both, normalised by the strings' own kernels and raised to POWER; inserted characters and gaps lower a match but don't end
it. Words begin with a mark, so that their starts count. The kernel of two sentences is the sum of this kernel over the pairs of
their words. With landmarks (short strings of the labelled sentences: those that tell the labels apart, and others) a sentence is
the sum of its words' Nyström features, and the machine is a linear one on sentences.

It is trained on sentences: those of toxic documents against those of clean ones. A toxic document need have only some toxic
sentences, so the machine then chooses anew which of them it is trained on (each document keeps its most suspicious one).
A document's score is a logistic function of its sentences' values, fitted on documents that the machine hadn't seen (FOLDS).

Fitting uses at most SAMPLE documents of each label, the first by a hash of doc_id, of at most MOST_CHARS characters; of several rows
with one doc_id one is learnt from. Scoring covers whole texts. Null and empty texts have no sentences and get the score of none.
Labels that are null, or that contradict each other for a doc_id, are not learnt from. Without labels of both kinds all
scores are 0. Repeated rows get equal scores; an empty table gives an empty result. Columns may have any other names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Recent, held, map_batches, texts

LENGTH, DECAY, POWER = 3, 0.6, 2
#: Documents of each label that are learnt from and the characters these may have; documents of each label and fold that calibrate; landmarks.
SAMPLE, MOST_CHARS, CALIBRATION, LANDMARKS, FOLDS = 1200, 60_000, 250, 64, 2
#: Letters of a word that are compared at once, the step to the next such window, words of a sentence at most, letters of a landmark.
LETTERS, STEP, WORDS, GRAMS = 20, 10, 12, (4, 5, 6, 7, 8)
START = "^"
#: Log likelihood ratio from which a string tells the labels apart.
SURE = 7.5
#: Runs of single letters set apart ("i d i o t"), read as one word.
SPACED = re.compile(r"(?<!\S)\w(?:[ .*_-]+\w(?!\w)){2,}(?!\S)")
_NOISE = re.compile(r"[\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def codes(words: list[str]) -> np.ndarray:
    """Words as rows of code points, padded with 0."""
    width = max(map(len, words))
    return np.array([w.ljust(width, "\0") for w in words], dtype=f"<U{width}").view(np.uint32).reshape(len(words), width).astype(np.int32)


def kernel(words: list[str], against: list[str] | None) -> np.ndarray:
    """Unnormalised kernel: words x against; against None: of each word with itself, as one column.

    after[p] at a letter of the second word: weighted pairs of length-p subsequences that end at or before it; each letter of the
    first word moves all words and all seconds one step, so the work is letters x array operations.
    """
    s = codes(words).T  # letters x words
    t = (codes(words)[:, None, :] if against is None else codes(against)[None, :, :])
    shape = (len(words), t.shape[1], t.shape[2])
    total = np.zeros(shape, np.float32)
    # tail[p][..., j]: sum over i <= here, k < j of matches of length p ending at (i, k), decayed to (here, j)
    tail = [np.zeros((*shape[:2], shape[2] + 1), np.float32) for _ in range(LENGTH - 1)]
    powers = DECAY ** np.arange(shape[2] + 1, dtype=np.float32)
    spread = np.triu(powers[np.abs(np.subtract.outer(np.arange(shape[2]), np.arange(shape[2] + 1) - 1))].astype(np.float32), 1)  # k -> j > k: DECAY ** (j - 1 - k)
    for c in s:
        same = ((t == c[:, None, None]) & (c[:, None, None] != 0)).astype(np.float32) * (DECAY * DECAY)
        ended = [same] + [same * tail[p][..., :-1] for p in range(LENGTH - 1)]
        total += ended[-1]
        for p in range(LENGTH - 1):
            tail[p] *= DECAY
            tail[p] += (ended[p].reshape(-1, shape[2]) @ spread).reshape(tail[p].shape)
    return total.sum(axis=2)


@lru_cache(maxsize=64)
def subsequences(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all subsequences of LENGTH of n letters, and their weights."""
    places = np.array(list(combinations(range(n), LENGTH)), np.int64).reshape(-1, LENGTH)
    return places, (DECAY ** (places[:, -1] - places[:, 0] + 1)).astype(np.float32)


def subsequence_codes(letters: np.ndarray, places: np.ndarray, base: int) -> np.ndarray:
    """A number for each subsequence (rows of places) of each word (rows of letter numbers)."""
    out = letters[:, places[:, 0]]
    for k in range(1, LENGTH):
        out = out * base + letters[:, places[:, k]]
    return out


def own_kernel(words: list[str]) -> np.ndarray:
    return np.sqrt(np.maximum(kernel(words, None)[:, 0], 1e-12))


def sentences(text: str) -> list[list[str]]:
    """Sentences of a whole text as lower-case tokens, cut after WORDS of them; spaced-out words are joined."""
    low = SPACED.sub(lambda m: _NOISE.sub("", m[0]), text.lower())
    out = []
    for s in _SENTENCE.split(low):
        tokens = s.split()
        out += [tokens[k : k + WORDS] for k in range(0, len(tokens), WORDS)]
    return out


def words_of(token: str) -> list[str]:
    """What the kernel compares of a token: its letters after a start mark, at least LENGTH; long ones as overlapping windows."""
    w = token if token.isalpha() else _NOISE.sub("", token)
    if len(w) < LENGTH:
        return []
    w = START + w
    return [w] if len(w) <= LETTERS else [w[k : k + LETTERS] for k in range(0, len(w) - STEP, STEP)]


@dataclass
class Model:
    landmarks: list[str] = field(default_factory=list)
    own: np.ndarray | None = None
    mapping: np.ndarray | None = None  # landmarks -> features
    weights: np.ndarray | None = None
    bias: float = 0.0
    calibration: tuple[float, ...] = ()

    def lookup(self) -> tuple:
        """Letters of the landmarks by number (others are 0), and by subsequence of LENGTH of them where its landmarks and weights begin and how many they are."""
        if "_lookup" not in self.__dict__:
            letters = {c: k for k, c in enumerate(sorted(set("".join(self.landmarks))), 1)}
            held: dict[int, dict[int, float]] = {}
            for j, w in enumerate(self.landmarks):
                places, weights = subsequences(len(w))
                for key, weight in zip(subsequence_codes(np.array([[letters[c] for c in w]]), places, len(letters) + 1)[0].tolist(), weights.tolist()):
                    one = held.setdefault(key, {})
                    one[j] = one.get(j, 0.0) + weight
            begin, many = np.zeros((len(letters) + 1) ** LENGTH, np.int32), np.zeros((len(letters) + 1) ** LENGTH, np.int32)
            sizes = np.array([len(x) for x in held.values()])
            begin[list(held)], many[list(held)] = np.cumsum(sizes) - sizes, sizes
            self._lookup = letters, begin, many, np.array([j for x in held.values() for j in x]), np.array([v for x in held.values() for v in x.values()])
        return self._lookup

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_lookup"}

    def against_landmarks(self, words: list[str]) -> np.ndarray:
        """kernel(words, landmarks), by the subsequences that words share with any landmark; words of one length."""
        letters, begin, many, landmark, weight = self.lookup()
        places, own = subsequences(len(words[0]))
        number = np.zeros(max(map(ord, letters)) + 2, np.int32)
        number[list(map(ord, letters))] = list(letters.values())
        found = subsequence_codes(number[np.minimum(codes(words), len(number) - 1)], places, len(letters) + 1)
        row, place = np.nonzero(many[found])
        found = found[row, place]
        n = many[found]
        at = np.repeat(begin[found] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        size = len(self.landmarks)
        total = np.bincount(np.repeat(row * size, n) + landmark[at], np.repeat(own[place], n) * weight[at], len(words) * size)
        return total.reshape(len(words), size).astype(np.float32)

    def features(self, words: list[str]) -> np.ndarray:
        """Nyström features of words of one length."""
        return (self.against_landmarks(words) / own_kernel(words)[:, None] / self.own) ** POWER @ self.mapping

    def every_feature(self, words: list[str]) -> np.ndarray:
        """Of words in order of length, some at a time."""
        sizes = np.array([len(w) for w in words])
        out = []
        for n in np.unique(sizes).tolist():
            some, step = np.flatnonzero(sizes == n), max(16, 600_000 // max(1, len(subsequences(n)[1])))
            out += [self.features([words[i] for i in some[k : k + step]]) for k in range(0, len(some), step)]
        return np.vstack(out)

    def values(self, tokens: list[str]) -> list[float]:
        """What each token adds to its sentence's value."""
        parts = [words_of(t) for t in tokens]
        words = sorted({w for p in parts for w in p}, key=len)
        value = dict(zip(words, (self.every_feature(words) @ self.weights).tolist())) if words else {}
        return [sum(value[w] for w in p) for p in parts]

    def summaries(self, bodies: list[str], known: Recent) -> list[tuple[float, ...]]:
        """Of each text the highest sentence value, the mean of the three highest, and (as logarithms) how many are above one, the sum of those above zero and the number of sentences."""
        docs = [sentences(t) for t in bodies]
        value = known.of({t for d in docs for s in d for t in s}, self.values)
        out = []
        for d in docs:
            v = sorted([sum(map(value.__getitem__, set(s))) + self.bias for s in d], reverse=True) or [-1.0]
            out.append((v[0], sum(v[:3]) / len(v[:3]), float(np.log1p(sum(x > 1 for x in v))), float(np.log1p(sum(x for x in v if x > 0))), float(np.log1p(len(d)))))
        return out

    def scores(self, bodies: list[str], known: Recent | None = None) -> list[float]:
        if self.weights is None:
            return [0.0] * len(bodies)
        known = Recent() if known is None else known
        x = np.array(self.summaries(bodies, known)).reshape(-1, 5)
        return (1 / (1 + np.exp(-np.clip(x @ self.calibration[:-1] + self.calibration[-1], -30, 30)))).tolist()


def hinge_fit(positive: list[np.ndarray], negative: list[np.ndarray], start: np.ndarray | None = None, cost: float = 0.002, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps on the active set. Classes weigh the same in sum; the more
    rows, the less the machine is held back. Rows come in blocks, so little is copied."""
    n1, n0 = sum(map(len, positive)), sum(map(len, negative))
    size = (positive or negative)[0].shape[1] + 1
    w = np.zeros(size) if start is None else start
    ridge = np.eye(size)
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        left, right = ridge.copy(), np.zeros(size)
        for blocks, y, n in ((positive, 1.0, n1), (negative, -1.0, n0)):
            weigh = 0.5 / max(1, n) * (n1 + n0) ** 1.5 * cost
            for block in blocks:
                x = block[y * (block @ w[:-1] + w[-1]) < 1].astype(np.float64)
                total = x.sum(axis=0)
                left[:-1, :-1] += weigh * (x.T @ x)
                left[:-1, -1] += weigh * total
                left[-1, :-1] += weigh * total
                left[-1, -1] += weigh * len(x)
                right[:-1] += weigh * y * total
                right[-1] += weigh * y * len(x)
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, atol=1e-5):
            break
        w = new
    return w[:-1], float(w[-1])


def logistic_fit(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    xb = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(xb.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(xb @ w, -30, 30)))
        h = (xb * (p * (1 - p) + 1e-9)[:, None]).T @ xb + 0.05 * np.eye(len(w))
        step = np.linalg.solve(h, xb.T @ (y - p) - 0.05 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _grams(doc: list[list[str]], n: int) -> set[str]:
    """The strings of n letters within a document's words."""
    return {w[i : i + n] for w in {w for s in doc for w in s} for i in range(len(w) - n + 1)}


def gram_counts(docs: dict[int, list], folds: int) -> dict[tuple[int, int], Counter]:
    """How many documents of each label and fold hold each short string that is often enough in the toxic ones of a fold to matter; one length at a time, to save memory."""
    least = max(2, len(docs[1]) // (40 * folds))
    out = {(y, f): Counter() for y in docs for f in range(folds)}
    for n in GRAMS:
        toxic = [Counter() for _ in range(folds)]
        for f, seen in enumerate(toxic):
            for d in docs[1][f::folds]:
                seen.update(_grams(d, n))
        kept = {g for seen in toxic for g, k in seen.items() if k >= least}
        for f, seen in enumerate(toxic):
            out[1, f].update({g: k for g, k in seen.items() if g in kept})
            for d in docs[0][f::folds]:
                out[0, f].update(kept.intersection(_grams(d, n)))
        del toxic
    return out


def choose_landmarks(seen1: Counter, n1: int, seen0: Counter, n0: int, others: list[str], n: int, rng: np.random.Generator) -> list[str]:
    """Three quarters: strings that clearly more of the toxic documents hold, unlike each other; the rest: any of `others`. seen: documents by string."""
    worth, share = {}, n1 / (n1 + n0)
    for g, k in seen1.items():
        c = seen0[g]
        part = k / (k + c)
        # how unlikely it is that so many of its documents are toxic ones by chance (a log likelihood ratio)
        sure = k * np.log(part / share) + (c * np.log((1 - part) / (1 - share)) if c else 0.0)
        odds = np.log(k / n1) - np.log((c + 0.5) / (n0 + 1))
        if k >= max(3, n1 // 40) and sure > SURE and odds > 1.0:
            worth[g] = odds * (k * len(g)) ** 0.5
    out = _spread(sorted(worth, key=lambda g: (-worth[g], g))[:600], n * 3 // 4)
    pool = [w for w in others if w not in set(out)]
    return out + [pool[k] for k in rng.choice(len(pool), min(len(pool), n - len(out)), replace=False)]


def _spread(words: list[str], n: int) -> list[str]:
    """n words, each the foremost that is least like those chosen (by kernel)."""
    if len(words) <= n:
        return list(words)
    own = own_kernel(words)
    k = kernel(words, words) / np.outer(own, own)
    chosen, near = [0], k[0].copy()
    for _ in range(n - 1):
        gain = (1 - near) / (1 + np.arange(len(words))) ** 0.25
        gain[chosen] = -1
        chosen.append(int(gain.argmax()))
        near = np.maximum(near, k[chosen[-1]])
    return [words[i] for i in chosen]


def fit_sentences(docs: dict[int, list], landmarks: list[str]) -> Model:
    """The machine, without calibration. docs: by label, documents as sentences of words."""
    m = Model()
    if not landmarks or not all(docs.values()):
        return m
    m.landmarks, m.own = landmarks, own_kernel(landmarks)
    gram = ((kernel(m.landmarks, m.landmarks) / np.outer(m.own, m.own)) ** POWER).astype(np.float64)
    vals, vecs = np.linalg.eigh((gram + gram.T) / 2)
    keep = vals > 1e-3
    m.mapping = (vecs[:, keep] / np.sqrt(vals[keep])).astype(np.float32)
    words = sorted({w for y in docs for d in docs[y] for s in d for w in s}, key=len)
    if not words:
        return m
    x, at = m.every_feature(words), {w: i for i, w in enumerate(words)}

    def rows(some: list) -> list[np.ndarray]:
        """Of each document that has sentences with words, these sentences' features."""
        whole = []
        for d in some:
            sizes = [len(s) for s in d if s]
            if sizes:
                whole.append(np.add.reduceat(x[[at[w] for s in d for w in s]], np.cumsum([0, *sizes[:-1]]), axis=0))
        return whole

    def blocks(docs: list[np.ndarray]) -> list[np.ndarray]:
        return [np.vstack(docs[k : k + 64]) for k in range(0, len(docs), 64)]

    toxic, clean = rows(docs[1]), blocks(rows(docs[0]))
    if not toxic or not clean:
        return m
    used, w = toxic, None
    for _ in range(4):
        w, m.bias = hinge_fit(blocks(used), clean, w if w is None else np.r_[w, m.bias])
        # each document's sentences above zero, and its highest
        used = [f[(v > 0) | (np.arange(len(v)) == v.argmax())] for f in toxic for v in (f @ w + m.bias,)]
    m.weights = w.astype(np.float32)
    return m


def fit(toxic: list[str], clean: list[str], landmarks: int = LANDMARKS, seed: int = 5, folds: int = FOLDS) -> Model:
    """A model from labelled documents: folds give values of unseen documents for the calibration, then all documents the machine."""
    if not toxic or not clean:
        return Model()
    bodies, known = {1: toxic, 0: clean}, {}

    def as_words(sentence: list[str]) -> list[str]:
        return [w for t in set(sentence) for w in (known[t] if t in known else known.setdefault(t, words_of(t)))]

    docs = {y: [[as_words(s) for s in sentences(t)] for t in bodies[y]] for y in bodies}
    known.clear()
    seen = gram_counts(docs, folds)
    others = sorted({w[: GRAMS[-1]] for d in docs[0] for s in d for w in s if len(w) >= GRAMS[-1]})

    def machine(without: int | None) -> Model:
        part = {y: [d for i, d in enumerate(docs[y]) if i % folds != without] for y in docs}
        n = {y: sum((seen[y, f] for f in range(folds) if f != without), Counter()) for y in docs}
        return fit_sentences(part, choose_landmarks(n[1], max(1, len(part[1])), n[0], len(part[0]), others, landmarks, np.random.default_rng(seed)))

    m = machine(None)
    if m.weights is None:
        return Model()
    x, y = [], []
    for f in range(folds):
        one = machine(f)
        one = m if one.weights is None else one
        for label in bodies:
            some = bodies[label][f::folds][:CALIBRATION]
            x += one.summaries(some, Recent(most=16 << 20))
            y += [float(label)] * len(some)
    m.calibration = tuple(map(float, logistic_fit(np.array(x), np.array(y))))
    return m


def fold(doc_id: int | None) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5 if doc_id is not None else 0


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit_from_tables(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_chars: int = MOST_CHARS) -> Model:
    """Fit on at most `sample` documents of each label outside the held-out fold, with at most most_chars characters each: so much comes to the driver at most."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("toxic").alias("y"), F.max("toxic").alias("z")).where("y = z").where(~held_out())
    chosen = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    ids = chosen[0].unionByName(chosen[1]).select("doc_id", "y")
    rows = docs.select("doc_id", "text").where(F.length("text") <= most_chars).join(F.broadcast(ids), "doc_id")  # ids: 2 * sample rows
    by: dict[int, list[str]] = {0: [], 1: []}
    for r in rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).orderBy("doc_id").collect():
        by[int(r["y"])].append(r["text"])
    return fit(by[1], by[0])


def score_documents(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns and score, one row for each row; null and empty texts have a score too, an empty table gives an empty result."""
    kept = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
    body = df.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers for each landmark

    def run(b: pa.RecordBatch) -> dict:
        return {c: b.column(i) for i, c in enumerate(keep)} | {"score": pa.array(live_scores(body, texts(b, text)), pa.float64())}

    return map_batches(df.select(*keep, text), run, ", ".join([*kept, "score double"]))


def live_scores(body, bodies: list[str]) -> list[float]:
    """By a broadcast model; the worker remembers values of tokens."""
    model = body.value
    return model.scores(bodies, held(("toxicity", tuple(model.landmarks), model.bias), Recent))


def drop_toxic(df: DataFrame, model: Model, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The same columns and rows, repeated ones too, without the rows whose score reaches the threshold; whole texts are scored, null as empty ones."""
    names = df.columns
    body = df.sparkSession.sparkContext.broadcast(model)

    def run(b: pa.RecordBatch) -> dict:
        at = names.index(text)
        good = pa.array([s < threshold for s in live_scores(body, ["" if t is None else t for t in b.column(at).to_pylist()])], pa.bool_())
        kept = b.filter(good)
        return {c: kept.column(i) for i, c in enumerate(names)}

    return map_batches(df, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema))
