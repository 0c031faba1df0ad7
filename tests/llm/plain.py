"""Plain versions of the corpus operators, over lists, that tests hold the Spark ones against."""

from __future__ import annotations

import array
import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import xxhash

FOLDER = "/root/testdata/sf0.001"


def rows(sql: str, folder: str = FOLDER) -> list[tuple]:
    return duckdb.sql(sql.format(folder)).fetchall()


def documents(folder: str = FOLDER) -> dict[int, str]:
    return dict(rows("SELECT doc_id, text FROM '{}/documents.parquet'", folder))


def crc(key, parts: int) -> int:
    return zlib.crc32(str(key).encode()) % parts


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(ids: list[int], links: list[tuple[int, int]]) -> dict[int, int]:
    """The least id that links reach from each."""
    near = collections.defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    least: dict[int, int] = {}
    for i in sorted(ids):
        todo = [] if i in least else [i]
        while todo:
            x = todo.pop()
            if x not in least:
                least[x] = i
                todo += near[x]
    return least


def near_prints(prints: dict[int, int], within: int = 3) -> dict[int, int]:
    ids, values = list(prints), np.array(list(prints.values()), dtype=np.uint64)
    links = []
    for i in range(len(ids)):
        links += [(ids[i], ids[j]) for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= within)]
    return classes(ids, links)


def base_scores(texts: dict[int, str], parts: int = 5, left: int = 1) -> dict[int, tuple]:
    """n_tokens, n_known, train_tokens and base score of each document."""
    tokens = {d: [*(t or "").encode().lower().split(), None] for d, t in texts.items()}
    counts = collections.Counter(w for d, ws in tokens.items() if crc(d, parts) != left for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    return {
        d: (len(ws), sum(w in counts for w in ws), total, sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws))
        for d, ws in tokens.items()
    }


def pieces_hold(found: list, ids: dict[int, list[int]], size: int) -> int:
    """Checks pieces and sequences of a packing; returns the number of sequences."""
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(ids)
    for d, own in ids.items():
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(own)
            assert r["ids_crc32"] == zlib.crc32(array.array("I", own[at : at + r["length"]]).tobytes())
            at += r["length"]
        assert at == len(own)
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    return len(by_sequence)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Sizes in the tightest bin that holds each, largest first; the earliest of equal bins."""
    bins: list[list[int]] = []
    rooms: list[int] = []
    for s in sorted(sizes, reverse=True):
        fits = [(r, b) for b, r in enumerate(rooms) if r >= s]
        if fits:
            b = min(fits)[1]
        else:
            b = len(bins)
            bins.append([])
            rooms.append(max(capacity, s))
        bins[b].append(s)
        rooms[b] -= s
    return bins


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values) -> str:
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def merkle(leaves: list[str]) -> tuple[str, list[list[tuple[int, str | None]]]]:
    """The root, and for each leaf its siblings: (1 before, 2 after, 0 none) and digest, upwards."""
    proofs, places, now = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(now) > 1:
        for proof, p in zip(proofs, places, strict=True):
            other = p ^ 1
            proof.append((0, None) if other >= len(now) else (1 if p & 1 else 2, now[other]))
        places = [p // 2 for p in places]
        now = [digest(*now[i : i + 2]) for i in range(0, len(now), 2)]
    return now[0], proofs


def fold(own: str, proof) -> str:
    for side, other in proof:
        own = digest(other, own) if side == 1 else digest(own, other) if side == 2 else digest(own)
    return own


def runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by comparing each word with those one period later."""
    n, found = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(6, 4 * p):
                found.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def contaminated(texts: dict, items: dict, size: int = 13) -> set:
    """Documents of which a twentieth or more of the words lies in windows of items."""
    def words(t):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    windows = {tuple(w[i : i + size]) for w in map(words, items.values()) if w for i in range(max(len(w) - size, 0) + 1)}
    sizes, out = {len(w) for w in windows}, set()
    for d, t in texts.items():
        w = words(t)
        hit = {i + j for n in sizes for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for j in range(n)}
        if hit and 20 * len(hit) >= len(w):
            out.add(d)
    return out


def ftrl(rows: list[dict], labels: list[int], order: list[int], alpha=1.0, beta=1.0, l1=0.05, l2=0.05) -> dict:
    """Weights by feature after one follow-the-regularised-leader step for each row of `order`."""
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(f):
        return 0.0 if abs(z[f]) <= l1 else -(z[f] - math.copysign(l1, z[f])) / ((beta + math.sqrt(n[f])) / alpha + l2)

    for d in order:
        w = {f: weight(f) for f in rows[d]}
        p = 1 / (1 + math.exp(-sum(w[f] * x for f, x in rows[d].items())))
        for f, x in rows[d].items():
            g = (p - labels[d]) * x
            z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / alpha * w[f]
            n[f] += g * g
    return {f: weight(f) for f in z}
