"""Language identification by error-correcting output codes."""

from __future__ import annotations

import io
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beaconry.llm.learned import fit, scored

#: Bits of the places that n-grams are hashed to, and documents of each language that are learned from.
BITS, DOCUMENTS = 15, 1500
PLACES = 1 << BITS
#: Bytes of an n-gram.
ORDERS = (2, 3, 4)

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
KIND = T.StructType(
    [T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
)


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """A codeword of signs for each of n languages, far from each other.

    All two-way splits of up to six languages; beyond, random splits, as many as ten times the
    logarithm of n, the best of some draws.
    """
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        splits = [c for k in range(1, n // 2 + 1) for c in combinations(range(n), k) if 2 * k < n or 0 in c]
        code = -np.ones((n, len(splits)))
        for j, c in enumerate(splits):
            code[list(c), j] = 1
        return code
    rng, best = np.random.default_rng(seed), (-1, None)
    for _ in range(200):
        code = np.where(rng.random((n, int(np.ceil(10 * np.log2(n))))) < 0.5, -1.0, 1.0)
        apart = min((code[i] != code[j]).sum() for i, j in combinations(range(n), 2))
        best = max(best, (apart, code), key=lambda x: x[0])
    return best[1]


def grams(text: str | None) -> np.ndarray:
    """Places of all byte n-grams of the letters of a whole text, words apart by one space."""
    raw = b" " + b" ".join((text or "").encode().translate(_LOWER).split()) + b" "
    a = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    out = []
    for n in ORDERS:
        if len(a) >= n:
            mixed = np.full(len(a) - n + 1, n, dtype=np.uint32)
            for i in range(n):
                mixed = (mixed * np.uint32(0x01000193)) ^ a[i : len(a) - n + 1 + i]
            mixed *= np.uint32(0x9E3779B1)
            out.append(mixed >> np.uint32(32 - BITS))
    return np.concatenate(out)


def train(texts: list[str], langs: list[str], rounds: int = 8, rate: float = 0.5, seed: int = 1) -> bytes:
    """One logistic regression on shares of n-grams for each bit of the codewords."""
    names = sorted(set(langs))
    code = codewords(len(names))
    signs = code[[names.index(x) for x in langs]]
    held = []
    for t in texts:
        found = grams(t)
        at, n = np.unique(found, return_counts=True)
        held.append((at, (n / len(found)).astype(np.float32)))
    share = np.array([1 / langs.count(x) for x in names])[[names.index(x) for x in langs]]
    share *= len(langs) / share.sum()
    weight, past = np.zeros((PLACES, code.shape[1]), dtype=np.float32), np.full((PLACES, code.shape[1]), 1e-6, dtype=np.float32)
    bias = np.zeros(code.shape[1], dtype=np.float32)
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        for some in np.array_split(order.permutation(len(held)), max(1, len(held) // 64)):
            x = np.zeros((len(some), PLACES), dtype=np.float32)
            for i, d in enumerate(some):
                x[i, held[d][0]] = held[d][1]
            pull = signs[some] / (1 + np.exp(signs[some] * (x @ weight + bias))) * share[some][:, None]
            step = x.T @ (pull / len(some)).astype(np.float32)
            past += step**2
            weight += rate * step / np.sqrt(past)
            bias += 0.1 * pull.mean(axis=0)
    out = io.BytesIO()
    np.savez(out, weight=weight, bias=bias, code=code, names=np.array(names))
    return out.getvalue()


class Scorer:
    def __init__(self, model: bytes, sure: float):
        saved = np.load(io.BytesIO(model))
        self.weight, self.bias, self.code = saved["weight"].astype(np.float32), saved["bias"], saved["code"]
        self.names, self.sure = saved["names"].tolist(), sure

    def __call__(self, texts: list[str | None]) -> list[dict]:
        out = []
        for t in texts:
            if not t or not any(map(str.isalpha, t)):
                out.append({"lang": "und", "score": 0.0, "ambiguous": True})
                continue
            at = grams(t)
            margin = np.bincount(at, minlength=PLACES).astype(np.float32) @ self.weight / len(at) + self.bias
            # The loss of a codeword weighs each bit by how surely its classifier speaks against it.
            loss = np.logaddexp(0, -self.code * margin).sum(axis=1)
            near = np.exp(loss.min() - loss)
            score = float(near.max() / near.sum())
            out.append({"lang": self.names[int(loss.argmin())], "score": score, "ambiguous": score < self.sure})
        return out


def learn(rows: DataFrame, text: str = "text", lang: str = "lang") -> bytes | None:
    """A model from documents of known language, a bounded sample of which the caller chooses; None of no rows."""

    def run(texts, langs):
        from beaconry.llm import language

        return language.train(texts, langs)

    return fit(rows.where(F.col(lang).isNotNull()), run, text, lang)


def identify(docs: DataFrame, model: bytes | None, text: str = "text", out: str = "language", sure: float = 0.5) -> DataFrame:
    """`docs` with a struct `out`: lang, its score, and whether codewords leave it ambiguous (score under `sure`).

    Texts that are null or hold no letter are `und`, score 0, ambiguous; so are all without a model. Every row is read by
    itself, whole; a column named like `out` is replaced.
    """

    def scorer():
        from beaconry.llm.language import Scorer

        if model is None:
            return lambda texts: [{"lang": "und", "score": 0.0, "ambiguous": True} for _ in texts]
        return Scorer(model, sure)

    return scored(docs, text, out, KIND, scorer)
