"""SentencePiece BPE encoding with a merge-type prefix table.

A sequence of pieces is what BPE yields exactly if each pair of neighbours is what BPE yields for their joint text. So
each prefix of a text has one last token: of the pieces that end there (all found in one pass of an Aho-Corasick
automaton), the one that fits the last token of the prefix before it. A table holds that token for each prefix; the ids
are read off it backwards.

No piece of the model crosses from a letter to a word mark (this is checked on loading), so words are encoded one by
one and remembered in a bounded table. Runs of marks have pieces of equal score, for which the pair rule isn't
proven; they are merged step by step instead. Characters without a piece become byte pieces.

Nulls count as empty texts, which have no ids; texts of any length and repeated rows are encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import os
import re
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Recent, held, map_batches, texts

MARK = "▁"
#: What the table holds for the empty prefix.
FIRST = 1 << 30
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class Model:
    """What the encoder needs of a model file: pieces and scores, the automaton, and tables of decided pairs and known words."""

    def __init__(self, path: str, words: int = 96 << 20, pairs: int = 200_000):
        """words: bytes of remembered words; pairs: how many decided pairs are remembered."""
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, train = proto.normalizer_spec, proto.trainer_spec
        if train.model_type != 2 or norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or train.treat_whitespace_as_suffix or not train.byte_fallback or any(p.type in (USER, UNUSED) for p in proto.pieces):
            raise ValueError("a BPE model with byte fallback, identity normalisation and a leading mark is needed")
        self.piece = [p.piece for p in proto.pieces]
        self.score = [p.score for p in proto.pieces]
        self.id = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        if any(a != MARK == b for s in self.id for a, b in zip(s, s[1:])):
            raise ValueError("a piece crosses a word boundary")
        self.byte = [next(i for i, p in enumerate(proto.pieces) if p.type == BYTE and p.piece == f"<0x{b:02X}>") for b in range(256)]
        self.chars = {c for s in self.id for c in s}
        self.auto = ahocorasick.Automaton()
        for s, i in self.id.items():
            self.auto.add_word(s, (i, len(s)))
        self.auto.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.spines: tuple[dict, dict] = ({}, {})
        self.words = Recent(self.word, words, 300)
        self.decimal = list(map(str, range(len(self.piece))))
        self.most_pairs = pairs
        cut = re.escape("".join(c for c in "\n\t\r" if c not in self.chars))
        #: Words with the spaces before them; characters that have no piece stand alone.
        self.split = re.compile(rf" *[^ {cut}]+| +|[{cut}]" if cut else r" *[^ ]+| +").findall

    def merge(self, s: str, steps: list[str] | None = None) -> list[int]:
        """Plain BPE: the best-scored joint piece first, the leftmost of equals. s has only known characters. steps: gets each merge's left part."""
        part: list[str | None] = list(s)
        left, right = list(range(-1, len(s) - 1)), [*range(1, len(s)), -1]
        heap: list[tuple[float, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (joint := part[a] + part[b]) in self.id:
                heapq.heappush(heap, (-self.score[self.id[joint]], a, joint))

        for k in range(len(s) - 1):
            offer(k, k + 1)
        while heap:
            _, a, joint = heapq.heappop(heap)
            if part[a] is None or (b := right[a]) < 0 or part[a] + part[b] != joint:
                continue
            if steps is not None:
                steps.append(part[a])
            part[a], part[b] = joint, None
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [self.id[p] for p in part if p is not None]

    def spine(self, i: int, side: int) -> list[tuple[str, float]] | None:
        """What stands at the piece's right (side 1) or left (0) end while BPE builds it: (text, score of the merge that takes it away).

        None if BPE doesn't yield the piece, or if a part of it scores no better than the whole: time then isn't score.
        """
        known = self.spines[side].get(i, 0)
        if known == 0:
            s = self.piece[i]
            if len(s) == 1:
                known = [(s, -math.inf)]
            elif (halves := self.halves(s)) is None or any(len(h) > 1 and self.score[self.id[h]] <= self.score[i] for h in halves):
                known = None
            elif (inner := self.spine(self.id[halves[side]], side)) is None or self.spine(self.id[halves[1 - side]], side) is None:
                known = None
            else:
                known = [*inner[:-1], (inner[-1][0], self.score[i]), (s, -math.inf)]
            self.spines[side][i] = known
        return known

    def halves(self, s: str) -> list[str] | None:
        """The two pieces that BPE joins last to make s, or None if it doesn't make s."""
        steps: list[str] = []
        if self.merge(s, steps) != [self.id[s]]:
            return None
        left = steps[-1]
        return [left, s[len(left) :]]

    def fits(self, a: int, b: int) -> bool:
        """Whether BPE keeps these two pieces apart, and whole, when they stand side by side. a below 0: b stands first."""
        if a < 0:
            return self.merge(self.piece[b]) == [b]
        x, y = self.spine(a, 1), self.spine(b, 0)
        joint = self.piece[a] + self.piece[b]
        if x is None or y is None or joint.startswith(MARK * 2):
            return joint not in self.id and self.merge(joint) == [a, b]
        i = j = 0
        while True:
            (left, gone_left), (right, gone_right) = x[i], y[j]
            k = self.id.get(left + right)
            if k is not None and (r := self.score[k]) > gone_left and r >= gone_right:
                return False
            if i == len(x) - 1 and j == len(y) - 1:
                return True
            if gone_left >= gone_right:
                i += 1
            else:
                j += 1

    def table(self, s: str) -> list[int]:
        """ids of a run of known characters: forwards each prefix's last token, then backwards the ids."""
        n = len(s)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        last[0] = FIRST
        pairs = self.pairs
        for end, (i, k) in self.auto.iter(s):  # of the pieces that end at one place, the longest comes first
            end += 1
            if last[end] >= 0 or (before := last[end - k]) == -1:
                continue
            key = before << 32 | i
            if (fit := pairs.get(key)) is None:
                if len(pairs) >= self.most_pairs:
                    pairs.clear()
                fit = pairs[key] = self.fits(-1 if before == FIRST else before, i)
            if fit:
                last[end], size[end] = i, k
        if last[n] == -1:
            raise AssertionError("a prefix has no last token")
        out, at = [], n
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def word(self, w: str) -> tuple[int, ...]:
        """ids of a word with its leading spaces."""
        s = w.replace(" ", MARK)
        return tuple(self.known_runs(s, self.merge if s.startswith(MARK * 2) else self.table))

    def known_runs(self, s: str, encode) -> list[int]:
        if self.chars.issuperset(s):
            return encode(s)
        out, run = [], []
        for c in s:
            if c in self.chars:
                run.append(c)
                continue
            if run:
                out += encode("".join(run))
                run = []
            out += [self.byte[b] for b in c.encode("utf-8", "replace")]
        return out + (encode("".join(run)) if run else [])

    def parts(self, text: str) -> list[str]:
        return self.split(" " + text.replace(MARK, " ")) if text else []

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.words.__getitem__, self.parts(text))))

    def encode_both(self, text: str) -> tuple[list[int], str]:
        """ids, and the same as decimal numbers joined by commas."""
        ids = self.encode(text)
        return ids, ",".join(map(self.decimal.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.lib.decode(ids)


def model_of(path: str) -> Model:
    """One model a worker process. path: a file, or the name of one of the installed public tokenizers."""
    real = path
    if not os.path.exists(path):
        import public_tokenizers

        real = public_tokenizers.path(path)
    return held(("sentencepiece", path), lambda: Model(real))


def encode_documents(df: DataFrame, model: str = "piece_bpe_32k.model", text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, ids (array of int) and decoded (the text that the ids stand for)."""
    kept = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]

    def run(b: pa.RecordBatch) -> dict:
        m = model_of(model)
        ids = [m.encode(t) for t in texts(b, text)]
        return {c: b.column(i) for i, c in enumerate(keep)} | {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": [m.decode(x) for x in ids]}

    return map_batches(df.select(*keep, text), run, ", ".join([*kept, "ids array<int>", "decoded string"]))


def token_digest(df: DataFrame, model: str = "piece_bpe_32k.model", text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256. The ids themselves stay in the worker."""
    kept = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]

    def run(b: pa.RecordBatch) -> dict:
        m = model_of(model)
        n, digest, back = [], [], []
        for t in texts(b, text):
            ids, decimal = m.encode_both(t)
            n.append(len(ids))
            digest.append(hashlib.sha256(decimal.encode()).hexdigest())
            back.append(hashlib.sha256(m.decode(ids).encode()).hexdigest())
        return {c: b.column(i) for i, c in enumerate(keep)} | {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": digest, "decoded_sha256": back}

    return map_batches(df.select(*keep, text), run, ", ".join([*kept, "n_tokens long", "ids_sha256 string", "decoded_sha256 string"]))
