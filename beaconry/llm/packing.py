"""Packing documents into sequences: shortest pack first over the histogram of lengths."""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from beaconry.llm.common import columns, released, slices, stored

#: Pieces of one length that are ranked together, about.
RANKED = 50_000


def _piece_batches(batches: Iterator[pa.RecordBatch], key: str, path: str, size: int, end: int) -> Iterator[pa.RecordBatch]:
    from beaconry.llm.tokens import Encoder

    encode, tail = Encoder(path, array.tobytes), array("I", [end]).tobytes()
    names = [key, "start", "length", "ids_crc32", "doc_tokens"]
    for batch in batches:
        (texts,) = columns(batch, "_text")
        rows, start, length, crc, total = [], [], [], [], []
        for a, b in slices(texts):
            for i, values in enumerate(encode(texts[a:b]), a):
                values.append(tail)
                ids = memoryview(b"".join(values))
                n = len(ids) // 4
                for s in range(0, n, size):
                    rows.append(i)
                    start.append(s)
                    length.append(min(size, n - s))
                    crc.append(zlib.crc32(ids[4 * s : 4 * (s + size)]))
                    total.append(n)
        keys = batch.column(batch.schema.get_field_index(key)).take(pa.array(rows, pa.int32()))
        yield pa.RecordBatch.from_arrays([keys, *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], names=names)


def pieces(docs: DataFrame, tokenizer: str, size: int, end: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents as runs of at most `size` ids: key, start, length, ids_crc32, doc_tokens.

    A document is the tokenizer's ids of its whole text and then `end`; only its last piece is shorter
    than `size`.
    """
    kind = docs.schema[key].dataType

    def scan(batches):
        from beaconry.llm import packing

        yield from packing._piece_batches(batches, key, tokenizer, size, end)

    fields = [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens")]
    source = docs.select(key, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    return source.mapInArrow(released(scan), T.StructType([T.StructField(key, kind), *fields]))


def patterns(histogram: dict[int, int], size: int) -> list[tuple[int, dict[int, int]]]:
    """Packing patterns (how many sequences, lengths in each with their multiplicities).

    Lengths are placed longest first, each into the shortest packs that have room for it; packs that
    look alike are one pattern with a count, so the work follows the histogram, not the documents.
    """
    room: dict[int, list[tuple[int, dict[int, int]]]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            space = max((s for s, packs in room.items() if packs and s >= length), default=0)
            if not space:
                # New packs of this length alone: as many as would be filled if it had no other place.
                count = -(-left // (size // length)) if length * 2 <= size else left
                room[size].append((count, {}))
                continue
            count, held = room[space].pop()
            placed = min(count, left)
            room[space - length].append((placed, held | {length: held.get(length, 0) + 1}))
            if count > placed and (held or space < size):
                room[space].append((count - placed, held))
            left -= placed
    return [(c, held) for s in sorted(room) for c, held in room[s] if held]


def _slots(found: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, ranks, first sequence, sequences, offset) that give ranks their places."""
    taken: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for count, held in found:
        offset = 0
        for length, times in held.items():
            rows.append((length, taken[length], count * times, sequence, count, offset))
            taken[length] += count * times
            offset += length * times
        sequence += count
    return rows


def pack(pieces: DataFrame, size: int = 2048, key: str = "doc_id") -> DataFrame:
    """Give pieces of at most `size` ids a sequence_id and an offset in it.

    The histogram of lengths has at most `size` rows; patterns are made from it on the driver, and so
    is their table of ranks, which is bounded by it too and is broadcast. Pieces of a length are ranked
    in parts, the more the commoner it is, so a common length is no single task. Repeated rows are packed each;
    a null key is packed like any other; other columns are kept; no pieces give no sequences.
    """
    spark = pieces.sparkSession
    # A table, as pieces must keep the rank they were given.
    pieces = stored(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    parts = 16 + max(histogram.values(), default=0) // RANKED
    pieces = pieces.withColumn("_part", F.pmod(F.xxhash64("_row"), F.lit(parts)))
    counts = pieces.groupBy("length", "_part").count()
    slots = spark.createDataFrame(
        _slots(patterns(histogram, size)), "length bigint, _first bigint, _ranks bigint, _sequence bigint, _count bigint, _offset bigint"
    )
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    ranked = (
        pieces.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_part").orderBy("_row")) - 1)
        .join(starts, ["length", "_part"])
        .withColumn("_rank", F.col("_rank") + F.col("_before"))
    )
    inside = F.col("_rank") - F.col("_first")
    placed = ranked.join(F.broadcast(slots), "length").where((inside >= 0) & (inside < F.col("_ranks")))
    rest = [c for c in pieces.columns if c not in ("_row", "_part", "sequence_id", "offset")]
    return placed.select(
        *rest,
        (F.col("_sequence") + inside % F.col("_count")).alias("sequence_id"),
        (F.col("_offset") + F.col("length") * F.floor(inside / F.col("_count"))).cast("bigint").alias("offset"),
    )


def pack_documents(
    docs: DataFrame, tokenizer: str, size: int = 2048, end: int = 1, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Tokenise, cut and pack documents; null texts are empty, so they have the end id alone."""
    return pack(pieces(docs, tokenizer, size, end, key, text), size, key)
