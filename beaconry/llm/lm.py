"""Language-model scores: bigrams and unigrams mixed by deleted interpolation.

A document is its words and then one end. The corpus is cut into blocks of whole documents. A block's
distinct words and word pairs go, as sorted 64-bit hashes with their counts, to ranges of the hash
space, where the counts of all blocks are added; every block gets the totals of just what it asked
for, in the order it asked. So no task holds the model, and what is shuffled follows the input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.llm.common import Kept, columns, stored

#: Tokens after which a block is closed.
BLOCK_TOKENS = 1 << 19
#: The end of a document, which is also what its first word follows; no word is a space.
END = np.uint64(xxhash.xxh64_intdigest(b" ") & ~1)
#: Context frequencies are mixed by powers of two, and probabilities counted by quarters of them.
BANDS, STEPS = 32, 4

_SCHEMA = (
    "block bigint, held boolean, train_tokens bigint, ids array<bigint>, train array<boolean>, sizes array<int>, "
    "words binary, vocab binary"
)


def _pack(a: np.ndarray) -> bytes:
    """Bytes of like significance side by side, compressed."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), -1).T.tobytes())


def _unpack(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _block_batches(batches: Iterator[pa.RecordBatch], key: str, text: str) -> Iterator[pa.RecordBatch]:
    hashes = Kept(lambda word: xxhash.xxh64_intdigest(word) & ~1)  # even numbers are words
    task, number = TaskContext.get().partitionId(), 0
    open_blocks: dict[bool, list] = {False: [], True: []}
    held_tokens = {False: 0, True: 0}

    def close(held: bool) -> pa.RecordBatch:
        nonlocal number
        docs = open_blocks[held]
        tokens = np.concatenate([d[2] for d in docs])
        vocab, words = np.unique(tokens, return_inverse=True)
        number += 1
        row = {
            "block": [(task << 32) + number], "held": [held], "train_tokens": [sum(len(d[2]) for d in docs if d[1])],
            "ids": [[d[0] for d in docs]], "train": [[d[1] for d in docs]], "sizes": [[len(d[2]) for d in docs]],
            "words": [_pack(words.astype(np.uint32))], "vocab": [_pack(vocab)],
        }
        open_blocks[held], held_tokens[held] = [], 0
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))

    for batch in batches:
        for i, t, train, held in zip(*columns(batch, key, text, "_train", "_held"), strict=True):
            words = (t or "").encode().lower().split()
            tokens = np.empty(len(words) + 1, dtype=np.uint64)
            tokens[:-1] = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
            tokens[-1] = END
            open_blocks[held].append((i, train, tokens))
            held_tokens[held] += len(tokens)
            if held_tokens[held] >= BLOCK_TOKENS:
                yield close(held)
    for held, docs in open_blocks.items():
        if docs:
            yield close(held)


def blocks_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The corpus as a stored table of blocks; `docs` has _train, and _held for what the mixture is fitted on."""

    def scan(batches):
        from beaconry.llm import lm

        yield from lm._block_batches(batches, key, text)

    return stored(docs.select(F.col(key).cast("bigint").alias(key), text, "_train", "_held").mapInArrow(scan, _SCHEMA), "lm-blocks")


class _Block:
    """A block's tokens, its distinct keys in order, and where each token's keys are."""

    def __init__(self, row: dict):
        self.ids, self.train, self.sizes = row["ids"], np.array(row["train"]), np.array(row["sizes"])
        vocab = _unpack(row["vocab"], np.uint64)
        words = _unpack(row["words"], np.uint32).astype(np.int64)
        end = np.searchsorted(vocab, END)
        before = np.concatenate([[end], words[:-1]])
        pairs, pair = np.unique(before * len(vocab) + words, return_inverse=True)
        mixed = (vocab[pairs // len(vocab)] * np.uint64(0x9E3779B97F4A7C15)) ^ (vocab[pairs % len(vocab)] * np.uint64(0xC2B2AE3D27D4EB4F))
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        keys = np.concatenate([vocab, mixed | np.uint64(1)])
        order = np.argsort(keys, kind="stable")
        place = np.empty(len(keys), dtype=np.int64)
        place[order] = np.arange(len(keys))
        self.keys = keys[order]
        self.word, self.context, self.pair = place[words], place[before], place[len(vocab) + pair]

    def counts(self) -> np.ndarray:
        """Training occurrences of each key."""
        weight = np.repeat(self.train, self.sizes).astype(np.float64)
        n = len(self.keys)
        return (np.bincount(self.word, weight, n) + np.bincount(self.pair, weight, n)).astype(np.uint32)


_ASKED = "bucket int, block bigint, held boolean, keys binary, counts binary"


def _ask_batches(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            block = _Block(row)
            counts = block.counts()
            bucket = (block.keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(block.keys), np.int64)
            cuts = np.searchsorted(bucket, np.arange((1 << bits) + 1))
            out = [
                (b, row["block"], row["held"], _pack(np.diff(block.keys[x:y], prepend=np.uint64(0))), _pack(counts[x:y]))
                for b, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if y > x
            ]
            kinds = [pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["bucket", "block", "held", "keys", "counts"]
            )


_TOLD = "bucket int, block bigint, held boolean, known bigint, total binary, fitted binary"


def _add_up(asked: pa.Table) -> pa.Table:
    """Totals over all blocks for each key that a block asked for, in the order it asked.

    `total` counts all training documents, `fitted` those that the mixture is not fitted on; `known` has
    the distinct training words of the range, once.
    """
    rows = asked.to_pylist()
    keys = [np.cumsum(_unpack(r["keys"], np.uint64), dtype=np.uint64) for r in rows]
    sizes = [len(k) for k in keys]
    every = np.concatenate(keys)
    counts = np.concatenate([_unpack(r["counts"], np.uint32) for r in rows]).astype(np.int64)
    fitted = np.where(np.repeat([r["held"] for r in rows], sizes), 0, counts)
    distinct, where = np.unique(every, return_inverse=True)
    total = np.bincount(where, counts, len(distinct)).astype(np.int64)
    rest = np.bincount(where, fitted, len(distinct)).astype(np.int64)
    known = int(((total > 0) & ((distinct & np.uint64(1)) == 0)).sum())
    out, start = [], 0
    for i, (r, n) in enumerate(zip(rows, sizes, strict=True)):
        at = where[start : start + n]
        start += n
        out.append((r["bucket"], r["block"], r["held"], known if i == 0 else 0, _pack(total[at]), _pack(rest[at]) if r["held"] else None))
    kinds = [pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()]
    names = ["bucket", "block", "held", "known", "total", "fitted"]
    return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def _told(table: pa.Table, name: str) -> np.ndarray:
    rows = sorted(table.select(["bucket", name]).to_pylist(), key=lambda r: r["bucket"])
    return np.concatenate([_unpack(r[name], np.int64) for r in rows])


def _band(contexts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(contexts + 1).astype(np.int64), BANDS - 1)


def _parts(counts: np.ndarray, block: _Block, tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context frequency, and the likelihood estimates of pair and word, for each token."""
    context = counts[block.context]
    pair = np.divide(counts[block.pair], context, out=np.zeros(len(context)), where=context > 0)
    return context, pair, counts[block.word] / max(tokens, 1)


def _steps(p: np.ndarray) -> np.ndarray:
    """Probabilities in steps; 1 for none."""
    return np.where(p > 0, np.round(STEPS * np.log2(np.maximum(p, 1e-300))), 1).astype(np.int64)


def _held_out(blocks: pa.Table, told: pa.Table, tokens: int) -> pa.Table:
    """How often held-out tokens have a context band and probabilities, in steps."""
    found = []
    for row in blocks.to_pylist():
        context, pair, word = _parts(_told(told, "fitted"), block := _Block(row), tokens)
        seen = np.stack([_band(context), _steps(pair), _steps(word)], axis=1)
        values, n = np.unique(seen, axis=0, return_counts=True)
        found.append(np.concatenate([values, n[:, None]], axis=1))
        del block
    out = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    return pa.Table.from_arrays([pa.array(out[:, i]) for i in range(4)], names=["band", "pair", "word", "n"])


def mixture(rows: list[tuple[int, int, int, int]], distinct: int, rounds: int = 60) -> np.ndarray:
    """Weights of pair, word and uniform estimates for each context band, by expectation-maximisation.

    `rows` are held-out counts (band, pair, word, n), probabilities in steps. One held-out token for each estimate is
    assumed in every band; a band of contexts never seen gives the pair no weight.
    """
    weights = np.full((BANDS, 3), 1 / 3)
    data = np.array(rows, dtype=np.float64).reshape(-1, 4)
    uniform = 1 / (distinct + 1)
    for band in range(BANDS):
        seen = data[data[:, 0] == band]
        p = np.stack([*(np.where(seen[:, i] <= 0, 2.0 ** (seen[:, i] / STEPS), 0) for i in (1, 2)), np.full(len(seen), uniform)], axis=1)
        prior = np.array([0.0 if band == 0 else 1.0, 1.0, 1.0])
        w = prior / prior.sum()
        for _ in range(rounds):
            share = p * w
            share *= (seen[:, 3] / np.maximum(share.sum(axis=1), 1e-300))[:, None]
            w = share.sum(axis=0) + prior
            w /= w.sum()
        weights[band] = w
    return weights


def _score_block(blocks: pa.Table, told: pa.Table, weights: np.ndarray, tokens: int, distinct: int) -> pa.Table:
    out = [[], [], [], [], []]
    for row in blocks.to_pylist():
        block = _Block(row)
        counts = _told(told, "total")
        context, pair, word = _parts(counts, block, tokens)
        w = weights[_band(context)]
        score = np.log10(w[:, 0] * pair + w[:, 1] * word + w[:, 2] / (distinct + 1))
        own = counts[block.word]
        base = np.log10((own + 0.5) / (tokens + 0.5 * (distinct + 1)))
        starts = np.concatenate([[0], np.cumsum(block.sizes)[:-1]])
        out[0] += block.ids
        out[1] += block.sizes.tolist()
        for i, v in ((2, own > 0), (3, base), (4, score)):
            out[i] += np.add.reduceat(v.astype(np.float64), starts).tolist()
    known = [int(x) for x in out[2]]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    names = ["_key", "n_tokens", "n_known", "base_score", "score"]
    return pa.Table.from_arrays([pa.array(v, k) for v, k in zip([out[0], out[1], known, *out[3:]], kinds, strict=True)], names=names)


def score(docs: DataFrame, training, key: str = "doc_id", text: str = "text", held: int = 20) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of each whole document.

    `training` is a condition on `docs`; it chooses the documents counted. One in `held` of those, by a hash of
    the key, is left out while the mixture of pair, word and uniform estimates is fitted to it, and
    counted when documents are scored. A-Z are lowered; words end at ASCII white space. Null
    texts are empty: one end. Null keys and repeated rows are documents, too. Where nothing is held
    out the weights are even. The key must be whole numbers. No documents give no rows.
    """
    spark = docs.sparkSession
    train = F.coalesce(training, F.lit(False))
    flagged = docs.select(key, text, train.alias("_train")).withColumn(
        "_held", F.col("_train") & (F.pmod(F.xxhash64(F.lit("mixture"), F.col(key)), F.lit(held)) == 0)
    )
    blocks = blocks_of(flagged, key, text)
    tokens = blocks.agg(F.sum("train_tokens"), F.sum(F.when(~F.col("held"), F.col("train_tokens")))).first()
    total, fitted = (int(x or 0) for x in tokens)
    # Ranges grow with the root of the blocks, and so do a range's share of the corpus and the pieces of a block.
    bits = math.isqrt(16 * blocks.count()).bit_length()

    def ask(batches):
        from beaconry.llm import lm

        yield from lm._ask_batches(batches, bits)

    def add_up(table):
        from beaconry.llm import lm

        return lm._add_up(table)

    told = stored(blocks.mapInArrow(ask, _ASKED).groupBy("bucket").applyInArrow(add_up, _TOLD), "lm-totals")
    distinct = int(told.agg(F.sum("known")).first()[0] or 0)

    def held_out(a, b):
        from beaconry.llm import lm

        return lm._held_out(a, b, fitted)

    seen = (
        blocks.where("held").groupBy("block").cogroup(told.where("held").groupBy("block"))
        .applyInArrow(held_out, "band bigint, pair bigint, word bigint, n bigint")
        .groupBy("band", "pair", "word").agg(F.sum("n").alias("n"))
    )
    weights = mixture([tuple(r) for r in seen.collect()], distinct)

    def score_block(a, b):
        from beaconry.llm import lm

        return lm._score_block(a, b, weights, total, distinct)

    scored = (
        blocks.groupBy("block").cogroup(told.select("bucket", "block", "total").groupBy("block"))
        .applyInArrow(score_block, "_key bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    )
    return scored.select(
        F.col("_key").alias(key), "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score"
    )
