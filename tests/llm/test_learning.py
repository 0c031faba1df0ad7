"""Trainers and scorers beside plain versions, and the recall of sorted passes where windows do not hold a label."""

import collections
import io
import math
import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import plain  # noqa: E402

from beaconry.llm import decontaminate, embeddings, language, learned, quality, toxicity  # noqa: E402
from beaconry.llm.common import Kept  # noqa: E402
from beaconry.llm.queries import QUERIES  # noqa: E402


def texts(n=200, seed=11):
    """Short texts of common words; a bad word makes a sentence, and its text, bad."""
    rng = np.random.default_rng(seed)
    out, labels = [], []
    for _ in range(n):
        bad = bool(rng.random() < 0.4)
        lines = [" ".join(rng.choice(["the", "cat", "sat", "on", "a", "mat", "über"], 5)) for _ in range(int(rng.integers(1, 5)))]
        if bad:
            lines[int(rng.integers(len(lines)))] += " rotten fool"
        out.append(". ".join(lines) + ".")
        labels.append(int(bad))
    return [*out, "", "One"], [*labels, 0, 0]


def test_quality_is_plain_ftrl():
    """The saved weights are those of a trainer over dictionaries, step for step, and scores are their dot products."""
    own, labels = texts()
    rows = []
    for t in own:
        places = quality.grams(t, Kept(quality.xxhash.xxh64_intdigest)).tolist()
        n = collections.Counter(places)
        rows.append({**{p: math.sqrt(c / len(places)) for p, c in n.items()}, "bias": 1.0})
    rng = np.random.default_rng(1)
    want = plain.ftrl(rows, labels, [int(d) for _ in range(3) for d in rng.permutation(len(rows))])
    model = quality.train(own, labels)
    saved = np.load(io.BytesIO(model))
    got = {("bias" if p == quality.PLACES else p): w for p, w in zip(saved["at"].tolist(), saved["weight"].tolist(), strict=True)}
    assert got == {f: pytest.approx(w, abs=1e-9) for f, w in want.items() if w}
    for t, row, r in zip(own, rows, quality.Scorer(model)(own), strict=True):
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-sum(want[f] * x for f, x in row.items())))), t


def test_toxicity_is_plain_noisy_or():
    """Scores are one less the product of what sentences leave, by plain sums of the saved weights; fitting makes them likely."""
    own, labels = texts()
    model = toxicity.train(own, labels)
    saved = np.load(io.BytesIO(model))
    weight = dict(zip(saved["at"].tolist(), saved["weight"].tolist(), strict=True))
    loss = 0.0
    for t, y, r in zip(own, labels, toxicity.Scorer(model, 0.3)(own), strict=True):
        left = 1.0
        for s in toxicity.sentences(t):
            z = float(saved["bias"]) + sum(weight.get(p, 0.0) for w in set(s.split()) for p in toxicity.places_of(w))
            left *= 1 - 1 / (1 + math.exp(-z))
        assert r["score"] == pytest.approx(1 - left, abs=1e-9)
        loss -= math.log(max(1 - left if y else left, 1e-12))
    assert loss / len(own) < 0.3  # 0.67 for the share of bad texts alone


def test_language_is_plain_decoding():
    """The language is that of the codeword with the least summed logistic loss over plain margins."""
    kinds = {"en": "the cat and the dog of that house", "de": "der Hund und die Katze nicht weit", "fr": "le chien et la maison des gens"}
    rng = np.random.default_rng(2)
    own = [(" ".join(rng.permutation(t.split())), x) for x, t in kinds.items() for _ in range(60)]
    model = language.train([t for t, _ in own], [x for _, x in own])
    saved = np.load(io.BytesIO(model))
    for t, r in zip([t for t, _ in own], language.Scorer(model, 0.5)([t for t, _ in own]), strict=True):
        found = language.grams(t).tolist()
        margin = [float(saved["bias"][b]) + sum(float(saved["weight"][g, b]) for g in found) / len(found) for b in range(saved["code"].shape[1])]
        loss = {x: sum(math.log1p(math.exp(-c * m)) for c, m in zip(code, margin, strict=True)) for x, code in zip(saved["names"].tolist(), saved["code"].tolist(), strict=True)}
        least = min(loss, key=loss.get)
        assert r["lang"] == least and r["score"] == pytest.approx(1 / sum(math.exp(loss[least] - v) for v in loss.values()), abs=1e-4)
    assert np.mean([r["lang"] == x for r, (_, x) in zip(language.Scorer(model, 0.5)([t for t, _ in own]), own, strict=True)]) > 0.98


@pytest.mark.parametrize(("name", "label", "least"), [("op5_toxicity", "toxic", (0.65, 0.85)), ("op6_quality", "quality", (0.7, 0.85))])
def test_predictions_of_held_out_labels(spark, name, label, least):
    """Precision and recall of `predicted`, which is the score at 0.3."""
    folder = "/root/testdata/sf0.1"
    known = dict(plain.rows(f"SELECT doc_id, {label} FROM '{{}}/labels.parquet'", folder))
    held = [(r["predicted"], known[r["doc_id"]]) for r in QUERIES[name](spark, folder).collect() if r["held_out"] and r["doc_id"] in known]
    both = sum(p and y for p, y in held)
    precision, recall = both / max(1, sum(p for p, _ in held)), both / max(1, sum(y for _, y in held))
    print(name, len(held), round(precision, 3), round(recall, 3))
    assert precision >= least[0] and recall >= least[1]


def test_fit_is_bounded_in_characters(spark, monkeypatch):
    monkeypatch.setattr(learned, "CHARACTERS", 10)
    rows = spark.createDataFrame([("aaaa", 1), ("bbbb", 0), ("cccc", 1), ("x" * 50, 1), (None, 0)], "text string, label int")
    assert learned.fit(rows, lambda t, y: repr(sorted(map(len, t))).encode(), "text", "label") == b"[0, 4, 4]"


@pytest.mark.parametrize("n", [10_000])
def test_passes_find_isolated_pairs(spark, n):
    """Pairs at cosine 0.981 in one label far larger than a window, which no chain of links connects."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = rng.standard_normal((500, 64))
    side -= (side * x[:500]).sum(axis=1)[:, None] * x[:500]
    side /= np.linalg.norm(side, axis=1)[:, None]
    near = 0.981 * x[:500] + math.sqrt(1 - 0.981**2) * side
    x = np.concatenate([x, near])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").withColumn("label", F.lit(1))
    got = embeddings.near_vectors(df).where("n_links > 0").collect()
    found = {(r["component_id"], r["vec_id"]) for r in got if not r["kept"]}
    wanted = {(i, n + i) for i in range(500)}
    print("recall", n, len(found & wanted) / 500)
    assert found <= wanted and len(found) >= 0.9 * len(wanted)


def test_long_verbatim_passages(spark):
    """An item and a document of the same 20 000 words, beside their parts."""
    words = [f"w{i % 7001}x{i % 13}" for i in range(20_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[5000:5012])), (3, "a b " + " ".join(words[7000:9000]) + " c")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[100:140]))], "item_id bigint, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], tuple(r["items"]), len(r["spans"] or [])) for r in decontaminate.contamination(docs, items).collect()}
    assert got == {1: (20_000, 20_000, ("1", "2"), 1), 2: (12, 0, (), 0), 3: (2003, 2000, ("1",), 1)}
