"""Quality: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader."""

from __future__ import annotations

import io
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from beaconry.llm.common import Kept
from beaconry.llm.learned import fit, scored

#: Places that n-grams are hashed to, and documents that are learned from.
PLACES, DOCUMENTS = 1 << 20, 12_000

_TOKENS = re.compile(rb"[a-z0-9\x80-\xff]+|[^\x00-\x20a-z0-9\x80-\xff]+").findall
KIND = T.StructType([T.StructField("score", T.DoubleType())])


def grams(text: str | None, hashes: dict) -> np.ndarray:
    """Places of all words and of all pairs of neighbours.

    Two equal neighbours are one feature whatever the word; so is the text's beginning.
    """
    words = _TOKENS((text or "").encode().lower())
    one = np.empty(len(words) + 1, dtype=np.uint64)
    one[0] = 1
    one[1:] = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    pair = (one[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (one[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    pair[one[:-1] == one[1:]] = 2
    return (np.concatenate([one, pair]) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(44)).astype(np.int64)


def sparse(places: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places and their values: roots of counts, so that all values of a text make a vector of length one."""
    at, n = np.unique(places, return_counts=True)
    return at, np.sqrt(n / total)


def train(texts: list[str], labels: list[int], rounds: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.05, l2: float = 0.05, seed: int = 1) -> bytes:
    """FTRL-proximal: a weight leaves zero only when its summed gradients exceed `l1`."""
    hashes = Kept(xxhash.xxh64_intdigest)
    held = [sparse(g, len(g)) for g in (grams(t, hashes) for t in texts)]
    z, n = np.zeros(PLACES + 1), np.zeros(PLACES + 1)

    def weight(at, l1):
        own = z[at]
        return np.where(np.abs(own) <= l1, 0.0, -(own - np.sign(own) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(rounds):
        for d in order.permutation(len(held)):
            at, x = held[d]
            at, x = np.append(at, PLACES), np.append(x, 1.0)  # the last place is the bias
            w = weight(at, l1)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - labels[d]) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weight(np.arange(PLACES + 1), l1)
    out = io.BytesIO()
    np.savez(out, at=np.flatnonzero(w), weight=w[w != 0])
    return out.getvalue()


class Scorer:
    def __init__(self, model: bytes):
        saved = np.load(io.BytesIO(model))
        self.weight = np.zeros(PLACES + 1)
        self.weight[saved["at"]] = saved["weight"]
        self.some = self.weight != 0
        self.hashes = Kept(xxhash.xxh64_intdigest)

    def __call__(self, texts: list[str | None]) -> list[dict]:
        out = []
        for t in texts:
            places = grams(t, self.hashes)
            at, x = sparse(places[self.some[places]], len(places))
            z = float(self.weight[at] @ x + self.weight[PLACES])
            out.append({"score": 1 / (1 + float(np.exp(-min(max(z, -35.0), 35.0))))})
        return out


def learn(rows: DataFrame, text: str = "text", label: str = "quality") -> bytes | None:
    """A model from labelled documents, a bounded sample of which the caller chooses; None of no rows."""

    def run(texts, labels):
        from beaconry.llm import quality

        return quality.train(texts, labels)

    return fit(rows, run, text, label)


def score(docs: DataFrame, model: bytes | None, text: str = "text", out: str = "quality") -> DataFrame:
    """`docs` with a struct `out`: the score of the whole text, a sparse dot product through the logistic function.

    Null and empty texts have the beginning alone. Without a model all scores are one half. Every row is scored by
    itself; a column named like `out` is replaced.
    """

    def scorer():
        from beaconry.llm.quality import Scorer

        if model is None:
            return lambda texts: [{"score": 0.5} for _ in texts]
        return Scorer(model)

    return scored(docs, text, out, KIND, scorer)
