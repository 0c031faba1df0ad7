"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import os
import sys

import numpy as np
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import plain  # noqa: E402

import corpus_pipeline  # noqa: E402
from beaconry.llm import chat, decontaminate, embeddings, language, lm, packing, quality, queries, simhash, tokens, toxicity  # noqa: E402

LONG = "word and " * 60_000
TEXTS = [(1, "one two three four."), (1, "one two three four."), (2, None), (3, ""), (4, " \n\t "), (None, "one two three four."), (5, LONG), (6, "ÄÖ é 日本 a\x1cb <|endoftext|>")]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, start string, row string, fp string, n_tokens string, items string, n string, label string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", None, 0, *["x"] * 8) for i, t in TEXTS], SCHEMA).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_token_counts(spark, docs, none, tmp_path):
    got = tokens.count_tokens(docs, path("byte_bpe_50k.json"), str(tmp_path / "cache"))
    assert got.columns == [c for c in docs.columns if c != "n_tokens"] + ["n_bytes", "n_tokens", "over_limit"]
    rows = got.collect()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    assert len(rows) == len(TEXTS)
    assert all(r["n_tokens"] == len(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in rows)
    cache = spark.read.parquet(str(tmp_path / "cache"))
    held = cache.count()
    assert held == len({t or "" for _, t in TEXTS})
    # A second run has nothing to encode; another tokenizer has all.
    assert tokens.count_tokens(docs, path("byte_bpe_50k.json"), str(tmp_path / "cache")).count() == len(TEXTS)
    assert spark.read.parquet(str(tmp_path / "cache")).count() == held
    pieces = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(docs, path("piece_bpe_32k.model"), str(tmp_path / "cache")).collect()}
    assert pieces[3] == 0 and pieces[1] > 0
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 2 * held
    assert tokens.count_tokens(none, path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_encode_as_whole_texts(name):
    rng = np.random.default_rng(4)
    signs = list("aB,.'s \n\t1é <|İ́") + ["\xa0", "\x1c", "　", "Σ", "日", "<|endoftext|>", "n't"]
    texts = ["".join(rng.choice(signs, 40)) for _ in range(1500)] + [t or "" for _, t in TEXTS]
    own = tokens.Encoder(path(name), tuple)
    assert own.cut is not None
    assert [[i for v in x for i in v] for x in own(texts)] == [list(x) for x in own.ids(texts)]


def test_words_with_every_character_encode_as_the_library_gives_them():
    """Capitals such as U+0181, whose small ones lie beyond the Latin letters, stay in their word; one look-up a piece."""
    texts = [f"ab{c}cd{c} {c}e f{c}" for c in map(chr, range(0x3000)) if c != "\0"]
    own = tokens.Encoder(path("word_bpe_49k.json"), tuple)
    asked = []
    library, own.ids = own.ids, lambda texts: asked.append(len(texts)) or library(texts)
    wanted = [list(x) for x in library(texts)]
    assert [[i for v in x for i in v] for x in own(texts)] == wanted
    first = sum(asked)
    assert [[i for v in x for i in v] for x in own(texts)] == wanted and sum(asked) == first


def test_simhash(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(TEXTS)
    got = {r["doc_id"]: r for r in rows}
    assert {got[i]["fingerprint"] for i in (2, 3, 4)} == {"0" * 16} and {got[i]["component_id"] for i in (2, 3, 4)} == {2}
    assert got[1]["component_id"] == got[None]["component_id"] == 1 and got[1]["fingerprint"] == got[None]["fingerprint"]
    assert all(int(r["fingerprint"], 16) == plain.fingerprint(dict(TEXTS)[r["doc_id"]]) for r in rows)
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_links_at_three_bits(spark):
    """Dense neighbourhoods beyond one block, and pairs at every distance, lose no link."""
    rng = np.random.default_rng(5)
    prints = [int(x) for x in rng.integers(0, 2**63, 400)]
    for p in prints[:200]:
        flipped = p
        for b in rng.permutation(64)[: rng.integers(1, 6)]:
            flipped ^= 1 << int(b)
        prints.append(flipped)
    centre = prints[0]
    prints += [centre ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)]
    prints = list(dict.fromkeys(prints))
    df = spark.createDataFrame([(i, p - 2**64 if p >= 2**63 else p) for i, p in enumerate(prints)], "id bigint, fp bigint")
    edges = [(r["a"], r["b"]) for r in simhash.edges(df).collect()]
    assert plain.classes(list(range(len(prints))), edges) == plain.near_prints(dict(enumerate(prints)))
    assert len(edges) < 20 * len(prints)


def test_pivot_tables_discard_no_link():
    rng = np.random.default_rng(6)
    a = rng.integers(0, 2**63, 50).astype(np.int64)
    b = a ^ (np.int64(1) << rng.integers(0, 63, 50)) ^ (np.int64(1) << rng.integers(0, 63, 50))
    marks = np.array(simhash.pivots(), dtype=np.int64)
    tables = [np.bitwise_count((x[:, None] ^ marks[None, :]).view(np.uint64)).astype(int) for x in (a, b)]
    assert np.abs(tables[0] - tables[1]).max() <= 3 and len(set(simhash.pivots())) == simhash.PIVOTS


def test_chat(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "&lt;| & &amp; <|turn|>", "", None, "<", "|>", "a\nb"]
    turns = [(1, i, r, t) for i, (r, t) in enumerate(zip(["user", "user", "assistant", "assistant", "system", None, "a&n;\n<|b"], nasty, strict=True))]
    turns += [(2, 0, "user", "tie b"), (2, 0, "user", "tie a"), (2, 0, "user", "tie a"), (2, None, "assistant", "last"), (None, 1, "assistant", "alone")]
    df = spark.createDataFrame([(*t, "x", "y") for t in turns], "conv_id bigint, turn bigint, role string, text string, formatted string, segments string")
    out = chat.format_chat(df)
    read = {r["conv_id"]: r for r in out.select("conv_id", "formatted", chat.parse_chat(F.col("formatted")).alias("t"), chat.loss_text(F.col("segments")).alias("l")).collect()}
    assert [(r["role"], r["text"]) for r in read[1]["t"]] == [(r or "", t or "") for _, _, r, t in turns[:7]]
    assert [r["text"] for r in read[2]["t"]] == ["tie a", "tie a", "tie b", "last"]
    assert read[1]["l"] == (nasty[2] or "") + (nasty[3] or "") and read[2]["l"] == "last" and read[None]["l"] == "alone"
    assert read[1]["formatted"].count(chat.START) == 5 and read[2]["formatted"].count(chat.START) == 2
    assert chat.format_chat(df.limit(0)).count() == 0


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path("word_bpe_49k.json"))
    distinct = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = packing.pack_documents(distinct, path("word_bpe_49k.json"), size=64).collect()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in TEXTS if i is not None}
    sequences = plain.pieces_hold(rows, ids, 64)
    assert sequences == -(-sum(map(len, ids.values())) // 64) or sequences * 64 < 1.05 * sum(map(len, ids.values())) + 64
    every = packing.pack_documents(docs, path("word_bpe_49k.json"), size=64).collect()
    assert len(every) == len({(r["sequence_id"], r["offset"]) for r in every}) == len(rows) + 2
    assert packing.pack_documents(none, path("word_bpe_49k.json")).count() == 0


def test_patterns_place_every_length():
    rng = np.random.default_rng(7)
    for size in (1, 8, 64, 2048):
        histogram = {int(n): int(rng.integers(1, 400)) for n in rng.integers(1, size + 1, 50)}
        found = packing.patterns(histogram, size)
        placed = {n: sum(c * held.get(n, 0) for c, held in found) for n in histogram}
        assert placed == histogram
        assert all(sum(n * k for n, k in held.items()) <= size for _, held in found)
    assert packing.patterns({}, 8) == []
    assert sum(c for c, _ in packing.patterns({1: 1000}, 10)) == 100


def test_learned_scores(spark, docs, none):
    clean, bad = "The sky is blue. Birds sing.", "The sky is blue. You utter idiot."
    rows = [(clean if i % 3 else bad, int(i % 3 == 0), int(i % 3 > 0), ["en", "xx"][i % 2]) for i in range(60)] + [(None, 0, 1, None), ("", 0, 1, None)]
    known = spark.createDataFrame(rows, "text string, toxic int, quality int, lang string")
    for own, label in ((toxicity, "toxic"), (quality, "quality")):
        model = own.learn(known, label=label)
        scored = own.score(docs, model, out="score")
        assert scored.columns == [c for c in docs.columns if c != "score"] + ["score"]
        found = scored.select("doc_id", "score.score").collect()
        assert len(found) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in found)
        two = own.score(spark.createDataFrame([(bad,), (clean,)], "text string"), model, out="o").select("o.*").collect()
        assert (two[0]["score"] > two[1]["score"]) == (label == "toxic")
        assert own.score(none, model).count() == 0
        assert own.learn(known.limit(0), label=label) is None
        assert own.score(docs, None).count() == len(TEXTS)
    found = toxicity.score(spark.createDataFrame([(bad,)], "text string"), toxicity.learn(known)).select("toxicity.sentences").first()[0]
    assert [bad.encode()[s["start"] : s["end"]].decode() for s in found] == [" You utter idiot"]


def test_language(spark, docs, none):
    texts = {"en": "the cat and the dog of that house", "de": "der Hund und die Katze nicht weit", "fr": "le chien et la maison des gens"}
    known = spark.createDataFrame([(t, x) for x, t in texts.items() for _ in range(20)] + [("what", None), (None, "en")], "text string, lang string")
    model = language.learn(known)
    got = language.identify(known.dropDuplicates(["text"]), model).select("text", "lang", "language.lang").collect()
    found = {r[0]: r[2] for r in got}
    assert all(found[t] == x for x, t in texts.items()) and found[None] == "und"
    rows = language.identify(docs, model, out="label").select("doc_id", "label.*").collect()
    assert {r["lang"] for r in rows if r["doc_id"] in (2, 3, 4)} == {"und"} and all(r["ambiguous"] for r in rows if r["lang"] == "und")
    assert len(rows) == len(TEXTS) and language.identify(none, model).count() == 0
    assert language.identify(docs, None).where("language.lang = 'und'").count() == len(TEXTS)
    assert language.learn(known.limit(0)) is None


@pytest.mark.parametrize("n", [1, 2, 4, 6, 9])
def test_codewords_differ(n):
    code = language.codewords(n)
    assert len({tuple(c) for c in code}) == n and (n < 3 or min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= 2)


def test_language_model(docs, none):
    rows = lm.score(docs, F.col("doc_id") != 6).collect()
    texts = [t for i, t in TEXTS if i not in (None, 6)]
    import collections
    import math

    counts = collections.Counter(w for t in texts for w in [*(t or "").encode().lower().split(), None])
    total = sum(counts.values())
    assert len(rows) == len(TEXTS) and {r["train_tokens"] for r in rows} == {total}
    for r in rows:
        own = [*(dict(TEXTS)[r["doc_id"]] or "").encode().lower().split(), None]
        assert r["n_tokens"] == len(own) and r["n_known"] == sum(w in counts for w in own)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in own))
        assert -1e9 < r["score"] <= 0
    assert lm.score(none, F.lit(True)).count() == 0
    assert lm.score(docs, F.lit(False)).where("train_tokens = 0 and n_known = 0").count() == len(TEXTS)


def test_mixture_is_the_likeliest():
    """Weights of expectation-maximisation beat others on the counts they were fitted to."""
    seen = [(3, -4, -20, 500), (3, 1, -16, 300), (3, 1, 1, 5), (0, 1, -12, 50)]
    w = lm.mixture(seen, 1000)
    p = np.array([[2.0**-1, 2.0**-5, 1 / 1001], [0, 2.0**-4, 1 / 1001], [0, 0, 1 / 1001]])
    n = np.array([500, 300, 5])
    best = (n * np.log(p @ w[3])).sum()
    assert all((n * np.log(p @ o)).sum() < best + 1 for o in np.random.default_rng(1).dirichlet([1, 1, 1], 300))
    assert np.allclose(w.sum(axis=1), 1) and w[0, 0] == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    held = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, None, 1), (7, [], 1),
        (8, [0.0, 0.0], 1), (9, [nan, 1.0], 1), (10, [inf, 1.0], 1), (11, [None, 1.0], 1), (12, [1.0], 1), (13, [0.0, 1.0], 1), (14, [0.0, 1.0], 1),
    ]
    df = spark.createDataFrame([(*h, "x", "y") for h in held], "vec_id bigint, embedding array<double>, label int, id string, n_links string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_vectors(df).collect()}
    assert got == {
        1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), 13: (1, 13, True), 14: (1, 13, False),
        **{i: (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12)},
    }
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_contamination(spark, docs, none):
    passage = " ".join(f"w{i}" for i in range(20))
    items = [(1, passage), (2, passage), (3, "Short, ITEM here"), (4, None), (5, "  .,"), (6, "one two three four")]
    texts = [
        (1, f"before {passage} after"), (2, " ".join(passage.split()[:12])), (3, "a short item HERE and there"), (4, None),
        (5, " ".join(passage.split()[3:16]) + " " + passage), (6, f"{passage} " + "filler " * 400), (None, "One, two: three four!"), (7, LONG),
        (1, "repeated key"),
    ]
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in texts], "doc_id bigint, text string, row string, items string, n_words string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in decontaminate.contamination(df, bench).collect())
    assert got == [
        (-1, 4, 4, ("6",), True), (1, 2, 0, (), False), (1, 22, 20, ("1", "2"), True), (2, 12, 0, (), False), (3, 6, 3, ("3",), True),
        (4, 0, 0, (), False), (5, 33, 33, ("1", "2"), True), (6, 420, 20, ("1", "2"), False), (7, 120_000, 0, (), False),
    ]
    found = {r["doc_id"]: r["spans"] for r in decontaminate.contamination(df.where("doc_id = 6"), bench).collect()}
    assert [(s["start"], s["end"]) for s in found[6]] == [(0, 20)]
    assert decontaminate.contamination(df, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(none, bench).count() == 0


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages(spark, docs, none, name, stage):
    out = stage(spark, docs, plain.FOLDER)
    if name == "packing":
        assert out.count() > 0
    else:
        assert out.columns == docs.columns
        kept = {(r["doc_id"], r["text"]) for r in out.select("doc_id", "text").collect()}
        gone = {t for t in TEXTS} - kept
        assert kept <= set(TEXTS)
        assert gone == {"toxicity": set(), "near-duplicates": {(3, ""), (4, " \n\t "), (None, TEXTS[0][1])}, "contamination": set()}.get(name, gone)
    assert stage(spark, none, plain.FOLDER).count() == 0


def test_stages_judge_every_document_by_itself(spark):
    """Contaminated documents without an id go; clean ones that share an id with them stay; of copies one stays."""
    item = plain.rows("SELECT text FROM '{}/benchmark.parquet' ORDER BY length(text) DESC LIMIT 1")[0][0]
    rows = [(None, item), (1, item), (1, "a clean text of its own"), (None, "another clean one"), (7, "twice the same words here"), (None, "twice the same words here"), (7, "a clean text of its own")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.drop_contaminated(spark, docs, plain.FOLDER)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted((i or 0, t) for i, t in rows if t != item)
    one = corpus_pipeline.drop_near_duplicates(spark, docs, plain.FOLDER).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in one) == sorted([(1, item), (1, rows[2][1]), (0, rows[3][1]), (7, rows[4][1])])


def test_pipeline(spark):
    """Each stage's decisions are those of a plain version, or of its operator, on what its predecessor kept."""
    folder = plain.FOLDER
    texts = plain.documents(folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept, frame = set(texts), docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = frame
        frame = stage(spark, frame, folder).cache()
        now = {r["doc_id"] for r in frame.select("doc_id").collect()}
        assert now <= kept
        if name == "near-duplicates":
            least = plain.near_prints({d: plain.fingerprint(texts[d]) for d in sorted(kept)})
            assert now == {d for d in kept if least[d] == d}
        if name == "toxicity":
            model = toxicity.learn(queries.labelled(spark, docs, folder, "toxic", 4, 2, toxicity.DOCUMENTS))
            assert now == {d for d in kept if toxicity.Scorer(model, 0.3)([texts[d]])[0]["score"] < 0.3} and len(now) > 0.7 * len(kept)
        if name == "language":
            known = before.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1)
            model = language.learn(known)  # all of these, as they are fewer than the bound
            assert now == {d for d in kept if not language.Scorer(model, 0.5)([texts[d]])[0]["ambiguous"]} and len(now) > 0.7 * len(kept)
        if name == "contamination":
            dirty = plain.contaminated({d: texts[d] for d in kept}, dict(plain.rows("SELECT item_id, text FROM '{}/benchmark.parquet'", folder)))
            assert now == kept - dirty
        kept = now
    before = spark.conf.get(corpus_pipeline.BATCH)
    packed = corpus_pipeline.run(spark, folder)
    assert spark.conf.get(corpus_pipeline.BATCH) == before
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == kept
