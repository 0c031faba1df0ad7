"""Sharding, manifests and periodic runs, beside plain versions, with the edges of their input."""

import collections
import os
import sys
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import plain  # noqa: E402

from beaconry.llm import manifest, runs, sharding  # noqa: E402
from beaconry.llm.queries import QUERIES  # noqa: E402

FOLDER = plain.FOLDER
LONG = "word and " * 3_000
TEXTS = [
    (1, "one two three four."), (1, "one two three four."), (2, None), (3, ""), (4, " \n\t "), (None, "one two three four."), (5, LONG),
    (6, "ÄÖ é 日本 a\x1cb " * 8), (7, "a a a a a a"), (8, "a a a a a"), (None, None), (9, "x " + "b c " * 4 + "b d d d d d d d"),
]
CLASH = "size string, slot string, shard string, leaf string, root string, proof string, total string, tree string, up string, hash string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i != 6 else None, None, i, *["x"] * 10) for i, t in TEXTS]
    return spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASH}").cache()


def test_best_fit_is_the_plain_one():
    rng = np.random.default_rng(3)
    for _ in range(60):
        sizes = rng.integers(1, rng.integers(2, 300), rng.integers(1, 200)).tolist()
        capacity = int(rng.integers(50, 400))
        got = sharding.best_fit(collections.Counter(sizes), capacity)
        assert [[s for s, n in held for _ in range(n)] for held in got] == plain.best_fit(sizes, capacity)
        assert sharding.best_fit(collections.Counter(sizes), capacity, len(got) - 1) is None
        shards = int(rng.integers(1, 30))
        even = sharding.level(collections.Counter(sizes), shards)
        assert len(even) <= shards
        assert collections.Counter(s for held in even for s, n in held for _ in range(n)) == collections.Counter(sizes)
        assert max(sum(s * n for s, n in held) for held in even) <= max(max(sizes), 2 * sum(sizes) // shards + 1)


def test_level_gives_large_groups_bins_of_their_own():
    sizes = collections.Counter({1000: 1, 10: 100})
    filled = sorted(sum(s * n for s, n in held) for held in sharding.level(sizes, 11))
    assert filled == [100] * 10 + [1000]
    assert sharding.level({}, 5) == []


def test_shards_are_the_plain_ones(spark):
    """All documents of a supplied table, beside groups, small ones bundled by hash, packed by plain best fit."""
    texts = plain.documents()
    found = QUERIES["op11_sharding"](spark, FOLDER).collect()
    size = {d: len((t or "").encode()) + 8 for d, t in texts.items()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in found} == {d: (size[d], zlib.crc32((t or "").encode())) for d, t in texts.items()}
    assert all(r["law"] == "bytes" and r["grown_shard"] is None for r in found)
    slots, filled, home = collections.defaultdict(list), collections.Counter(), collections.defaultdict(set)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        filled[r["shard"]] += r["size"]
        home[texts[r["doc_id"]] or ""].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(24))
    assert all(len(s) == 1 for s in home.values())
    assert max(filled.values()) <= 1.05 * sum(filled.values()) / 24 and min(filled.values()) >= 0.9 * sum(filled.values()) / 24
    groups = collections.Counter()
    for d, t in texts.items():
        groups[t or ""] += size[d]
    unit, things = -(-sum(groups.values()) // (24 * sharding.UNITS)), collections.Counter()
    for t, n in groups.items():
        own = plain.hashlib.sha256(t.encode()).digest()
        key = xxhash.xxh64_intdigest(own, 42)
        things[own if n >= unit else (key - (1 << 64) if key >> 63 else key) % (24 * sharding.UNITS)] += n
    bins = sharding.level(collections.Counter(things.values()), 24)
    largest = max(sum(s * n for s, n in held) for held in bins)
    assert sorted(filled.values()) == sorted(sum(b) for b in plain.best_fit(list(things.values()), largest))


def test_shard_edges(docs):
    got = sharding.shard(docs, 3)
    assert got.columns == [c for c in docs.columns if c not in ("text", "size", "shard", "slot")] + ["size", "text_crc32", "shard", "slot"]
    rows = got.collect()
    assert len(rows) == len(TEXTS) and len({(r["shard"], r["slot"]) for r in rows}) == len(rows)
    assert len({r["shard"] for r in rows if r["size"] == 8}) == 1  # nulls and the empty text
    alone = [r["shard"] for r in rows if r["size"] > 1000]
    assert len(alone) == 1 and sum(r["shard"] == alone[0] for r in rows) == 1
    # With few units, small groups are packed together by hash; nothing is lost, and equal texts stay together.
    few = sharding.shard(docs, 3, units=2, keep=["doc_id", "text"]).collect()
    assert len(few) == len(TEXTS) and len({r["shard"] for r in few if r["text"] == TEXTS[0][1]}) == 1
    fixed = sharding.shard(docs, 3, capacity=100, units=40_000).collect()
    filled = collections.Counter()
    for r in fixed:
        filled[r["shard"]] += r["size"]
    assert len(fixed) == len(TEXTS) and sorted(filled.values())[-1] == len(LONG) + 8 and sorted(filled.values())[-3] <= 118
    assert sharding.shard(docs.limit(0), 3).count() == 0
    with pytest.raises(ValueError, match="shards"):
        sharding.shard(docs, 3, capacity=10)


def plain_manifest(rows, key, group, values):
    """For each row (by its place in `rows`) its subroot, root and proof."""
    groups = collections.defaultdict(list)
    for at, r in enumerate(rows):
        groups[group(r)].append((key(r) is not None, key(r) or 0, plain.leaf(values(r)), at))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {g: plain.merkle([x[2] for x in sorted(groups[g])]) for g in order}
    root, above = plain.merkle([made[g][0] for g in order])
    out = {}
    for g, proof in zip(order, above, strict=True):
        for x, own in zip(sorted(groups[g]), made[g][1], strict=True):
            out[x[3]] = x[2], made[g][0], root, own + proof
    return out


@pytest.mark.parametrize("span", [1, 2, 8])
def test_manifest(spark, span):
    """Groups of one, two, odd and many rows, beside a plain tree; tampering shows."""
    sizes = {None: 1, "": 2, "a": 77, "Z": 5, "é": 300, "b": 64, "c": 65}
    rows = [(i, g, f"text {i} é", None if i % 5 == 0 else i) for g, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "id bigint, lang string, text string, n bigint")
    want = plain_manifest(rows, lambda r: r[0], lambda r: r[1], lambda r: r)
    made = manifest.manifest(df, ["id", "lang", "text", "n"], "lang", "id", span=span).withColumn("folded", manifest.fold(F.col("leaf"), F.col("proof")))
    got = made.withColumn("wrong", manifest.fold(F.sha2("text", 256), F.col("proof"))).withColumn("s", manifest.siblings(F.col("proof"))).collect()
    assert len(got) == len(rows)
    have = {(r["id"], r["lang"]): (r["leaf"], r["subroot"], r["root"], r["s"]) for r in got}
    assert have == {rows[at][:2]: (*w[:3], "".join(s or "" for _, s in w[3])) for at, w in want.items()}
    assert all(r["folded"] == r["root"] != r["wrong"] for r in got)


def test_manifest_edges(docs):
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    got = manifest.manifest(docs, fields, "lang", "doc_id")
    assert got.columns == [c for c in docs.columns if c not in ("leaf", "root", "proof")] + ["leaf", "subroot", "root", "proof"]
    rows = got.withColumn("folded", manifest.fold(F.col("leaf"), F.col("proof"))).collect()
    assert len(rows) == len(TEXTS) and all(r["folded"] == r["root"] for r in rows)
    source = [(i, None, "en" if i != 6 else None, i, t) for i, t in TEXTS]
    want = plain_manifest(source, lambda r: r[0], lambda r: r[2], lambda r: r)
    assert sorted((r["leaf"], r["subroot"], r["root"]) for r in rows) == sorted(w[:3] for w in want.values())
    assert manifest.manifest(docs.limit(0), fields, "lang", "doc_id").count() == 0
    one = manifest.manifest(docs.where("doc_id = 5"), fields, "lang", "doc_id").first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof"] == b""


def test_extensions_are_exact():
    rng = np.random.default_rng(8)
    for _ in range(80):
        w = np.append(rng.integers(0, int(rng.integers(1, 4)), int(rng.integers(2, 200))), 99)
        grammar, i, j = runs.Grammar(w), *rng.integers(0, len(w), (2, 100))
        i, j = i[i != j], j[i != j]

        def common(a, b, w=w):
            n = 0
            while max(a, b) + n < len(w) and w[a + n] == w[b + n]:
                n += 1
            return n

        assert grammar.extension(i, j).tolist() == [common(a, b) for a, b in zip(i, j, strict=True)]


@pytest.mark.parametrize(("small", "points"), [(runs.SMALL, runs.POINTS), (16, 50)])
def test_runs_are_the_plain_ones(monkeypatch, small, points):
    monkeypatch.setattr(runs, "SMALL", small)
    monkeypatch.setattr(runs, "POINTS", points)
    rng, grid = np.random.default_rng(9), runs._grid(small)
    for _ in range(150):
        texts = []
        for _ in range(int(rng.integers(1, 6))):
            w = rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(0, 150)))
            if len(w) > 20 and rng.random() < 0.5:
                a, p = int(rng.integers(0, len(w) - 8)), int(rng.integers(1, 8))
                w[a:] = w[a + (np.arange(len(w) - a) % p)]
            texts.append(w.astype(np.int64))
        assert [[tuple(r) for r in own.tolist()] for own in runs.find_runs(texts, grid)] == [plain.runs(w.tolist()) for w in texts]


def expected(words: list[str]):
    own = plain.runs(words)
    gone = {i for s, n, p in own for i in range(s + p, s + n)}
    return own, " ".join(w for i, w in enumerate(words) if i not in gone)


def test_periodic_runs(spark):
    """The registered query, its planting included, beside a plain reading of its contract."""
    texts = plain.documents()
    found = QUERIES["op13_periodic_runs"](spark, FOLDER).collect()
    assert len(found) == len(texts) and any(r["n_runs"] for r in found)
    for r in found:
        words = [w.decode() for w in (texts[r["doc_id"]] or "").encode().split()]
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        own, left = expected(words)
        best = max(own, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        want = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (len(own), *want)
        assert r["runs_sha256"] == plain.digest(*(f"{s},{n},{p}\n" for s, n, p in own)) and r["collapsed_sha256"] == plain.digest(left)


def test_periodic_edges(docs):
    got = runs.periodic_runs(docs.withColumn("periodic", F.lit(1)))
    assert got.columns == [*docs.columns, "periodic"]
    rows = got.collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        own, left = expected([w.decode() for w in (r["text"] or "").encode().split()])
        assert [tuple(x) for x in r["periodic"]["runs"]] == own and r["periodic"]["collapsed"] == left
    assert {r["doc_id"]: len(r["periodic"]["runs"]) for r in rows if r["doc_id"] in (5, 7, 8, 9)} == {5: 1, 7: 1, 8: 0, 9: 2}
    assert runs.periodic_runs(docs.limit(0)).count() == 0
