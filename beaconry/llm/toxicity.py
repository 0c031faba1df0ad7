"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, from labels of documents."""

from __future__ import annotations

import io

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from beaconry.llm.common import Kept
from beaconry.llm.learned import fit, scored

#: Places that words are hashed to, and documents that are learned from.
PLACES, DOCUMENTS = 1 << 18, 16_000
#: Bytes of the beginnings of words that are features beside the word.
BEGINNINGS = (4, 5, 6, 7)

#: Letters lowered, ends of sentences as line ends, other ASCII marks as spaces.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else 10 if b in b".!?\n\r" else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 or b == 39 else 32
    for b in range(256)
)

KIND = T.StructType(
    [
        T.StructField("score", T.DoubleType()),
        T.StructField(
            "sentences",
            T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])),
        ),
    ]
)


def places_of(word: bytes) -> set[int]:
    """Places of a word and of its beginnings, which inflected and compound words share."""
    digest = xxhash.xxh64_intdigest
    return {digest(word) % PLACES, *(digest(word[:n], n) % PLACES for n in BEGINNINGS if len(word) > n)}


def sentences(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split(b"\n")


def train(
    texts: list[str], labels: list[int], rounds: int = 6, rate: float = 0.2, l1: float = 2e-4, few: int = 4, seed: int = 1
) -> bytes:
    """Weights of words, and a bias, that make 1 - prod(1 - p(sentence)) likely for the labels.

    A feature that fewer than `few` documents hold has no weight, and weights shrink by `l1` at every step, which are
    scaled by the gradients so far.
    """
    y = np.array(labels, dtype=np.float64)
    held, parts = [], []
    for t in texts:
        places, owner = [], []
        own = sentences(t)
        for i, s in enumerate(own):
            found = [p for w in set(s.split()) for p in places_of(w)]
            places += found
            owner += [i] * len(found)
        held.append((np.array(places, dtype=np.int32), np.bincount(np.array(owner, dtype=np.int32), minlength=len(own)).astype(np.int32)))
        parts.append(len(own))
    frequency = np.zeros(PLACES, dtype=np.int64)
    for places, _ in held:
        frequency[np.unique(places)] += 1
    for d, (places, counts) in enumerate(held):  # one by one, as all are held
        keep = frequency[places] >= few
        held[d] = places[keep], np.bincount(np.repeat(np.arange(len(counts)), counts)[keep], minlength=len(counts)).astype(np.int32)
    weight, past = np.zeros(PLACES), np.full(PLACES, 1e-5)
    ones = min(max(y.mean(), 1e-3), 1 - 1e-3)
    bias, bias_past = float(np.log(ones / np.median(parts))), 1.0
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        for some in np.array_split(order.permutation(len(held)), max(1, len(held) // 64)):
            n = np.array([parts[d] for d in some])
            starts = np.cumsum(n) - n
            places = np.concatenate([held[d][0] for d in some])
            owner = np.repeat(np.arange(n.sum()), np.concatenate([held[d][1] for d in some]))
            z = bias + np.bincount(owner, weight[places], n.sum())
            clean = np.exp(np.minimum(-np.add.reduceat(np.logaddexp(0, z), starts), -1e-9))
            pull = np.repeat(np.where(y[some] > 0, clean / (1 - clean), -1.0), n) / (1 + np.exp(-z)) / len(some)
            step = np.bincount(places, pull[owner], PLACES)
            past += step**2
            pace = rate / np.sqrt(past)
            moved = weight + pace * step
            weight = np.where(step != 0, np.sign(moved) * np.maximum(np.abs(moved) - pace * l1, 0), weight)
            bias_past += pull.sum() ** 2
            bias += 0.05 * pull.sum() / np.sqrt(bias_past)
    out = io.BytesIO()
    np.savez(out, at=np.flatnonzero(weight), weight=weight[weight != 0], bias=bias)
    return out.getvalue()


class Scorer:
    """Scores texts; sentences at or over `report` are located, as bytes of the UTF-8 text."""

    def __init__(self, model: bytes, report: float):
        saved = np.load(io.BytesIO(model))
        weight = dict(zip(saved["at"].tolist(), saved["weight"].tolist(), strict=True))
        self.bias, self.report = float(saved["bias"]), report
        self.weight = Kept(lambda word: sum(weight.get(p, 0.0) for p in places_of(word))).__getitem__

    def __call__(self, texts: list[str | None]) -> list[dict]:
        out = []
        for t in texts:
            parts = sentences(t)
            z = np.array([sum(map(self.weight, set(s.split()))) for s in parts]) + self.bias
            score = float(-np.expm1(-np.logaddexp(0, z).sum()))
            p = 1 / (1 + np.exp(-z))
            found = []
            if p.max() >= self.report:
                ends = np.cumsum([len(s) + 1 for s in parts])
                found = [{"start": int(ends[i]) - len(parts[i]) - 1, "end": int(ends[i]) - 1, "score": float(p[i])} for i in np.flatnonzero(p >= self.report)]
            out.append({"score": min(max(score, 0.0), 1.0), "sentences": found})
        return out


def learn(rows: DataFrame, text: str = "text", label: str = "toxic") -> bytes | None:
    """A model from labelled documents, a bounded sample of which the caller chooses; None of no rows.

    Null texts are empty. Rows with null labels must be left out before.
    """

    def run(texts, labels):
        from beaconry.llm import toxicity

        return toxicity.train(texts, labels)

    return fit(rows, run, text, label)


def score(docs: DataFrame, model: bytes | None, text: str = "text", out: str = "toxicity", report: float = 0.3) -> DataFrame:
    """`docs` with a struct `out`: the whole text's score, and its sentences (start, end, score) at or over `report`.

    Places are bytes of the UTF-8 text. Null and empty texts are one empty sentence. Without a model all scores are
    zero. Every row is scored by itself; a column named like `out` is replaced.
    """

    def scorer():
        from beaconry.llm.toxicity import Scorer

        if model is None:
            return lambda texts: [{"score": 0.0, "sentences": []} for _ in texts]
        return Scorer(model, report)

    return scored(docs, text, out, KIND, scorer)
