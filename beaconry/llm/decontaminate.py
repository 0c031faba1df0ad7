"""Benchmark passages in documents: a prefix-filtered set join over windows of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from beaconry.llm.common import Kept, columns, plain_text, released, stored

#: Bits of the map of item shingles: 2 MB, whatever the items.
MAP_BITS = 24

#: Letters are lowered; all but a-z, 0-9 and bytes beyond ASCII become spaces.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or b >= 97 and b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORDS).split()


def _shingle_bits(hashes: np.ndarray, size: int) -> np.ndarray:
    """A place in the map for each shingle of `size` words."""
    n = len(hashes) - size + 1
    mixed = np.zeros(max(n, 0), dtype=np.uint64)
    if n > 0:
        for i in range(size):
            mixed = (mixed ^ hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(31)
    return (mixed >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        (texts,) = columns(batch, "_text")
        found = [[w.decode() for w in words_of(t)] for t in texts]
        ids = batch.column(batch.schema.get_field_index("item"))
        yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.list_(pa.string()))], names=["item", "words"])


def _place_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    hashes = Kept(xxhash.xxh64_intdigest)
    for batch in batches:
        (lists,) = columns(batch, "words")
        found = [_shingle_bits(np.array([hashes[w.encode()] for w in words], dtype=np.uint64), size) for words in lists]
        out = np.unique(np.concatenate([np.zeros(0, np.int64), *found]))
        yield pa.RecordBatch.from_arrays([pa.array(out)], names=["place"])


def _run_batches(
    batches: Iterator[pa.RecordBatch], key: str, marked: np.ndarray, size: int, least: int, window: int
) -> Iterator[pa.RecordBatch]:
    """For each document its words' count, and the stretches that hold `least` or more marked shingles in a row.

    A stretch is cut into parts of at most twice the window, which overlap by a window less one word, so each
    occurrence of a window lies whole in a part, and what is later made of a part's words stays small.
    """
    hashes = Kept(xxhash.xxh64_intdigest)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.list_(pa.string()))]))
    for batch in batches:
        (texts,) = columns(batch, "_text")
        counts, runs = [], []
        for t in texts:
            words = words_of(t)
            counts.append(len(words))
            own = []
            if len(words) >= size + least - 1:
                known = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
                places = _shingle_bits(known, size)
                hit = (marked[places >> 3] >> (places & 7).astype(np.uint8)) & 1
                if hit.any():
                    edge = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
                    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                        if b - a >= least:
                            end = b + size - 1
                            for s in range(a, max(end - window + 1, a + 1), window + 1):
                                own.append({"start": s, "words": [w.decode() for w in words[s : min(s + 2 * window, end)]]})
            runs.append(own)
        keys = batch.column(batch.schema.get_field_index(key))
        yield pa.RecordBatch.from_arrays([keys, pa.array(counts, pa.int64()), pa.array(runs, kind)], names=[key, "n_words", "runs"])


def _joined(words: Column, start: Column, n) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def _shingled(words: str, size: int) -> Column:
    """Structs (at, shingle) of a list of words; `at` counts from zero."""
    return F.transform(
        F.sequence(F.lit(0), F.size(words) - size), lambda i: F.struct(i.alias("at"), _joined(F.col(words), i + 1, size).alias("shingle"))
    )


def contamination(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    window: int = 13, shingle: int = 5, share: int = 20,
) -> DataFrame:
    """(key, n_words, n_hit, n_items, items, spans, contaminated) for each document.

    A window is `window` consecutive words of an item; an item of fewer words is one window, and one of none has none.
    A document's word inside any occurrence of a window is hit, and the document is contaminated when
    share * n_hit >= n_words > 0. `items` are the sorted keys, as text, of items with occurring windows, and
    `spans` the stretches (start, end) of hit words.

    A window is contained only where all its shingles are, so any one of them is a sufficient prefix:
    the one that documents hold least often. One scan of the documents keeps only stretches that may hold a
    window: runs of shingles, long enough for the shortest window, that a bitmap of all item shingles
    (of fixed size, so it is broadcast) does not rule out. These stretches give the frequencies, are joined
    with the windows on the rarest shingle, must have room for the window at the place the shingle sets,
    and are compared with it word by word.

    Texts that are null or have no words have n_words 0 and are clean. Rows are documents of their own, also
    with a repeated or null key. Equal items share windows, and each is named. No items leave all clean; no documents
    give no rows.
    """
    spark = docs.sparkSession

    def split(batches):
        from beaconry.llm import decontaminate

        yield from decontaminate._word_batches(batches)

    source = items.select(F.col(item_key).cast("string").alias("item"), plain_text(item_text).alias("_text"))
    lists = stored(source.mapInArrow(released(split), "item string, words array<string>").where(F.size("words") > 0), "item-words")
    shortest = lists.agg(F.min(F.least(F.size("words"), F.lit(window)))).first()[0] or window
    size = min(shingle, shortest)
    least = shortest - size + 1

    def places(batches):
        from beaconry.llm import decontaminate

        yield from decontaminate._place_batches(batches, size)

    bitmap = (
        lists.mapInArrow(released(places), "place bigint").groupBy(F.shiftright("place", 15).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.col("place").bitwiseAND(F.lit((1 << 15) - 1))).alias("bits"))
    )
    marked = np.zeros((1 << MAP_BITS) // 8, dtype=np.uint8)
    for row in bitmap.collect():  # at most 2 MB: the map has a fixed number of bits
        bits = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
        marked[row["bucket"] << 12 : (row["bucket"] << 12) + len(bits)] = bits
    shared = spark.sparkContext.broadcast(marked)

    def scan(batches):
        from beaconry.llm import decontaminate

        yield from decontaminate._run_batches(batches, key, shared.value, size, least, window)

    run_kind = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("words", T.ArrayType(T.StringType()))]))
    schema = T.StructType([docs.schema[key], T.StructField("n_words", T.LongType()), T.StructField("runs", run_kind)])
    scanned = stored(
        docs.select(key, plain_text(text).alias("_text")).mapInArrow(released(scan), schema).withColumn("row", F.monotonically_increasing_id()),
        "document-runs",
    )

    windows = (
        lists.select("item", "words", F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))).alias("at"))
        .select("item", F.slice("words", F.col("at"), window).alias("words"))
        .groupBy("words").agg(F.collect_set("item").alias("items"))
        .withColumn("window", F.array_join("words", " "))
    )
    runs = scanned.where(F.size("runs") > 0).select("row", F.explode("runs").alias("run")).select("row", "run.start", "run.words")
    spots = runs.select("row", "start", "words", F.explode(_shingled("words", size)).alias("s")).select(
        "row", "start", "words", "s.at", "s.shingle"
    )
    frequency = spots.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    parts = windows.select("window", "items", F.size("words").alias("long"), F.explode(_shingled("words", size)).alias("s")).select(
        "window", "items", "long", "s.at", "s.shingle"
    )
    prefix = (
        parts.join(frequency, "shingle", "left")
        .groupBy("window", "long")
        .agg(
            F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", F.col("at").alias("shift"))).alias("p"),
            F.first("items").alias("items"),
        )
        .where(F.col("p.n") > 0)
        .select("window", "long", "items", "p.shingle", "p.shift")
    )
    begin = F.col("at") - F.col("shift")
    # Spark sizes what was exploded by the file it came from, and would send it whole through the driver.
    hits = (
        spots.hint("merge").join(prefix, "shingle")
        .where((begin >= 0) & (begin + F.col("long") <= F.size("words")))
        .where(_joined(F.col("words"), begin + 1, F.col("long")) == F.col("window"))
        .select("row", (F.col("start") + begin).alias("a"), (F.col("start") + begin + F.col("long")).alias("b"), "items")
    )
    hits = stored(hits, "window-hits")
    past = Window.partitionBy("row").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("row").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, 0)
    spans = (
        hits.groupBy("row", "a").agg(F.max("b").alias("b"))
        .withColumn("reach", F.coalesce(F.max("b").over(past), F.lit(-1)))
        .withColumn("span", F.sum((F.col("a") > F.col("reach")).cast("int")).over(upto))
        .groupBy("row", "span").agg(F.min("a").alias("start"), F.max("b").alias("end"))
        .groupBy("row").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    )
    named = hits.select("row", F.explode("items").alias("item")).distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    found = spans.join(named, "row")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return scanned.select("row", key, "n_words").join(found, "row", "left").select(
        key, "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans",
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
