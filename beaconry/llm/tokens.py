"""Token counts with a cache of digests, and the bounded piece cache that encoders share."""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.llm.common import ENTRY, columns, plain_text, released, slices
from beaconry.session import work_folder

#: Characters that engines do not agree about as white space, and the start of special tokens.
_UNSURE = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u3000\ufeff]|<\|")
#: The pattern of the word tokenizer's file, and what it matches in Latin texts (fixed values).
_WORDS_AND_MARKS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS, _NUMBERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe"
_WORD = re.compile(rf"[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+").findall
_BEYOND_LATIN = re.compile("[^\t\n\r -~\xa1-įı-ɏ]").search
_LETTERS_ONLY = re.compile(f"[{_LETTERS}]+").fullmatch
_GAPS = re.compile(r"\s*\S+|\s+").findall
#: Bytes of pieces and values that one encoder keeps, and the longest piece worth keeping.
KEPT, LONGEST = 80 << 20, 80
#: Words that go to the library as one text.
TOGETHER = 100

_models: dict = {}


def gap_pieces(text: str) -> list[str]:
    """A text cut before every stretch of white space; whole where it holds an unsure character.

    A byte-level pattern never joins white space to what stands before it, so pieces encode alone as
    they do in the text.
    """
    return [text] if _UNSURE.search(text) else _GAPS(text)


def word_pieces(text: str) -> list[str]:
    """A text cut at spaces, for tokenizers that drop white space before they split."""
    if "\n" in text:
        text = text.replace("\n", " ")
    return text.split(" ")


def latin_pieces(text: str) -> list[str]:
    """A text in lower case, cut by `_WORDS_AND_MARKS`; at spaces only where it holds more than Latin letters.

    These texts are normalised already, and every character's class and lower case are plain. The text in lower case is
    looked at, as some capitals of the Latin letters have small ones beyond them.
    """
    lower = text.lower()
    return word_pieces(text) if "<|" in text or _BEYOND_LATIN(lower) else _WORD(lower)


def _shape(path: str) -> Callable[[str], list[str]] | None:
    """How texts may be cut for the tokenizer of this file without changing any id."""
    if not path.endswith(".json"):
        return None
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, normal, added = spec.get("pre_tokenizer") or {}, spec.get("normalizer"), spec.get("added_tokens") or []
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or not re.fullmatch(r"<\|\w+\|>", t["content"]) for t in added):
        return None
    if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not normal:
        return gap_pieces
    steps = pre.get("pretokenizers") or []
    kinds = {n["type"] for n in (normal or {}).get("normalizers", [])}
    if (
        [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["invert"] and steps[0]["behavior"] == "Removed"
        and " " not in steps[0]["pattern"].get("Regex", " ") and kinds <= {"NFC", "Replace", "Lowercase"}
    ):
        return latin_pieces if "Lowercase" in kinds and steps[0]["pattern"]["Regex"] == _WORDS_AND_MARKS else word_pieces
    return None


def _word_ends(path: str) -> np.ndarray | None:
    """By id, whether it ends a word; none where the tokenizer's file does not mark that in its tokens."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    suffix = model.get("end_of_word_suffix")
    if not suffix:
        return None
    ends = np.zeros(max(model["vocab"].values()) + 1, dtype=bool)
    for token, i in model["vocab"].items():
        ends[i] = token.endswith(suffix)
    return ends


def _library(path: str) -> Callable[[list[str]], list[list[int]]]:
    """What the library of the tokenizer's file gives for texts."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: pieces.encode(texts, num_threads=1)
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]


class Encoder:
    """The ids a tokenizer's library gives for whole texts, with pieces seen before kept.

    Where the tokenizer's own rules make the pieces of a text independent, each distinct piece is
    encoded by the library once and kept in a table of about `KEPT` bytes, which starts anew when
    full; other tokenizers encode whole texts. A task has an encoder of its own, so the table goes when the task ends;
    the library's model, as large as its file, stays in the worker.
    """

    def __init__(self, path: str, value: Callable[[array], object]):
        if path not in _models:
            _models.clear()
            cut = _shape(path)
            _models[path] = cut, _library(path), _word_ends(path) if cut is latin_pieces else None
        self.cut, self.ids, self.ends = _models[path]
        self.value, self.known, self.held = value, {}, 0

    def encoded(self, new: set[str]) -> dict[str, object]:
        """The values of the ids of each piece.

        Words of letters are encoded as texts of `TOGETHER` words, and cut after every id that ends a word: each
        word has at least one such id, so where their number is that of the words, each has just one.
        """
        out, rest = {}, new
        if self.ends is not None:
            words = list(filter(_LETTERS_ONLY, new))
            rest = new.difference(words)
            groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
            for group, own in zip(groups, self.ids([" ".join(g) for g in groups]), strict=True):
                ids = array("I", own)
                cuts = (np.flatnonzero(self.ends[np.frombuffer(ids, np.uint32)]) + 1).tolist()
                if len(cuts) != len(group) or cuts[-1] != len(ids):
                    rest.update(group)
                    continue
                out.update(zip(group, map(self.value, [ids[a:b] for a, b in pairwise([0, *cuts])]), strict=True))
        pieces = list(rest)
        out.update((p, self.value(array("I", ids))) for p, ids in zip(pieces, self.ids(pieces), strict=True))
        return out

    def __call__(self, texts: list[str]) -> Iterator[list]:
        """For each text the values of its pieces, in order."""
        if self.cut is None:
            yield from ([self.value(array("I", ids))] for ids in self.ids(texts))
            return
        pieces, stops = [], [0]
        for t in texts:
            pieces += self.cut(t)
            stops.append(len(pieces))
        values = list(map(self.known.get, pieces))
        unknown = [i for i, v in enumerate(values) if v is None]
        if unknown:
            new = self.encoded({pieces[i] for i in unknown})
            for i in unknown:
                values[i] = new[pieces[i]]
            self.keep(new)
        for a, b in pairwise(stops):
            yield values[a:b]

    def keep(self, new: dict[str, object]) -> None:
        new = {p: v for p, v in new.items() if len(p) <= LONGEST}
        size = sum(map(len, new)) + ENTRY * len(new)
        if self.held + size > KEPT:
            self.known.clear()
            self.held = 0
        self.known.update(new)
        self.held += size


def _count_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    count = Encoder(path, len)
    for batch in batches:
        (texts,) = columns(batch, "_text")
        out = []
        for a, b in slices(texts):
            out.extend(sum(v) for v in count(texts[a:b]))
        digest = batch.column(batch.schema.get_field_index("_digest"))
        yield pa.RecordBatch.from_arrays([digest, pa.array(out, pa.int64())], names=["digest", "n_tokens"])


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, text: str = "text", limit: int = 1024) -> DataFrame:
    """Add n_bytes, n_tokens and over_limit to documents; only contents the cache lacks are encoded.

    The cache at `cache` (a folder all executors share; a new one by default) has one row for each
    digest of content and of the tokenizer's file. Contents it lacks are reduced to one text each,
    encoded, and appended; a run that fails midway leaves it whole. Null counts as the empty text, of
    no bytes and no tokens; no other normalisation keeps counts, so none is made. Equal texts count
    alike, repeated rows stay, and columns of the result's names are replaced. No documents give no
    rows.
    """
    spark = docs.sparkSession
    cache = cache or work_folder(spark, "token-counts")
    version = F.lit(tokenizer_version(tokenizer))
    kept = spark.createDataFrame([], "version string, digest binary, n_tokens bigint")
    kept.write.mode("append").parquet(cache)
    digest = F.unhex(F.sha2(plain_text(text), 256))

    def count(batches):
        from beaconry.llm import tokens

        yield from tokens._count_batches(batches, tokenizer)

    def read():
        return spark.read.schema(kept.schema).parquet(cache).where(F.col("version") == version)

    missing = (
        docs.select(digest.alias("_digest"), plain_text(text).alias("_text"))
        .join(read().select(F.col("digest").alias("_digest")), "_digest", "left_anti")
        .groupBy("_digest")
        .agg(F.first("_text").alias("_text"))
    )
    missing.mapInArrow(released(count), "digest binary, n_tokens bigint").select(version.alias("version"), "digest", "n_tokens").write.mode(
        "append"
    ).parquet(cache)
    counts = read().groupBy("digest").agg(F.max("n_tokens").alias("_n"))
    rest = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    sized = docs.select(*(F.col(c) for c in rest), F.octet_length(plain_text(text)).cast("bigint").alias("n_bytes"), digest.alias("_digest"))
    return sized.join(counts.withColumnRenamed("digest", "_digest"), "_digest").select(
        *rest, "n_bytes", F.col("_n").alias("n_tokens"), (F.col("_n") > limit).alias("over_limit")
    )
