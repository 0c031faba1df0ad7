"""The corpus queries over the smallest supplied tables, beside plain versions or held-out labels."""

import os
import sys

import numpy as np
import pytest
from public_tokenizers import path

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import plain  # noqa: E402

from beaconry.llm.queries import QUERIES  # noqa: E402

FOLDER = plain.FOLDER


@pytest.fixture(scope="module")
def texts():
    return plain.documents()


def collect(spark, name, folder=FOLDER):
    return QUERIES[name](spark, folder).collect()


def encoded(name, texts):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path(name)).encode_batch([t or "" for t in texts.values()], add_special_tokens=False)
    return dict(zip(texts, (e.ids for e in found), strict=True))


def test_token_counts(spark, texts):
    ids = encoded("byte_bpe_50k.json", texts)
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in collect(spark, "op1_token_counts")}
    assert got == {d: (len((t or "").encode()), len(ids[d]), len(ids[d]) > 1024) for d, t in texts.items()}


def test_simhash(spark, texts):
    prints = {d: plain.fingerprint(t) for d, t in texts.items()}
    least = plain.near_prints(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in collect(spark, "op2_simhash")}
    assert got == {d: (f"{prints[d]:016x}", least[d]) for d in texts}
    assert len(set(least.values())) < len(least)


def test_packing(spark, texts):
    ids = {d: [*own, 1] for d, own in encoded("word_bpe_49k.json", texts).items()}
    found = collect(spark, "op4_packing")
    sequences = plain.pieces_hold(found, ids, 2048)
    assert sequences * 2048 < 1.03 * sum(map(len, ids.values())) + 2048
    assert {r["sequence_id"] for r in found} == set(range(sequences))


@pytest.mark.parametrize(("name", "label", "parts", "left"), [("op5_toxicity", "toxic", 4, 2), ("op6_quality", "quality", 5, 0)])
def test_labels(spark, name, label, parts, left):
    folder = "/root/testdata/sf0.1" if label == "toxic" else "/root/testdata/sf0.01"
    known = dict(plain.rows(f"SELECT doc_id, {label} FROM '{{}}/labels.parquet'", folder))
    found = collect(spark, name, folder)
    assert len(found) == len(plain.documents(folder))
    assert all(r["held_out"] == (plain.crc(r["doc_id"], parts) == left) and 0 <= r["score"] <= 1 for r in found)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in found)
    own = [(r["score"], known[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in known]
    ones, zeros = (np.array([s for s, y in own if y == v]) for v in (1, 0))
    assert (ones[:, None] > zeros[None, :]).mean() > 0.95


def test_language(spark):
    folder = "/root/testdata/sf0.01"
    known = dict(plain.rows("SELECT doc_id, lang FROM '{}/documents.parquet'", folder))
    held = [r for r in collect(spark, "op10_language", folder) if r["held_out"]]
    assert all(plain.crc(r["doc_id"], 3) == 1 for r in held)
    assert np.mean([r["lang_pred"] == known[r["doc_id"]] for r in held]) > 0.97


def test_language_model(spark, texts):
    want = plain.base_scores(texts)
    found = collect(spark, "op7_lm_score")
    assert len(found) == len(texts)
    for r in found:
        n, known, total, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base) and r["held_out"] == (plain.crc(r["doc_id"], 5) == 1)
    held = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_vectors_at_scale(spark):
    """All links are found where brute force finds them, in groups denser than a window too."""
    from beaconry.llm.embeddings import near_vectors

    rng = np.random.default_rng(2)
    centre = rng.standard_normal(32)
    near = centre + 0.02 * rng.standard_normal((700, 32))
    x = np.concatenate([near, rng.standard_normal((500, 32)), near[:50]])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    linked = unit @ unit.T >= 0.98
    np.fill_diagonal(linked, False)
    least = plain.classes(list(range(len(x))), [(int(a), int(b)) for a, b in np.argwhere(linked)])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(df, window=64).collect()}
    assert got == {i: (int(linked[i].sum()), least[i]) for i in range(len(x))}
