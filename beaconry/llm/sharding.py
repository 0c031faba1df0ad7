"""Shards of near-equal bytes: best-fit-decreasing bin packing of groups that must stay together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from beaconry.llm.common import plain_text, stored

#: Units of packing for each shard, so the largest error of a shard is about that share of it.
UNITS = 500
#: Bytes that a row has beside its text, and rows that are numbered in one part of a shard.
ROW_BYTES, NUMBERED = 8, 50_000


class Rooms:
    """Open bins ordered by (room, bin), in a balanced tree: a treap whose priorities are mixed keys."""

    def __init__(self):
        self.root = None

    @classmethod
    def _split(cls, node, key):
        """Nodes under `key`, and the rest."""
        if node is None:
            return None, None
        own, rank, left, right = node
        if own < key:
            low, high = cls._split(right, key)
            return (own, rank, left, low), high
        low, high = cls._split(left, key)
        return low, (own, rank, high, right)

    @classmethod
    def _merge(cls, low, high):
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            return low[0], low[1], low[2], cls._merge(low[3], high)
        return high[0], high[1], cls._merge(low, high[2]), high[3]

    def add(self, room: int, place: int) -> None:
        key = room, place
        low, high = self._split(self.root, key)
        rank = ((room * 0x9E3779B97F4A7C15) ^ (place * 0xC2B2AE3D27D4EB4F)) * 0xBF58476D1CE4E5B9 % 2**64
        self.root = self._merge(self._merge(low, (key, rank, None, None)), high)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin of least room that still holds `size`."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        first = high
        while first[2] is not None:
            first = first[2]
        _, rest = self._split(high, (first[0][0], first[0][1] + 1))
        self.root = self._merge(low, rest)
        return first[0]


def best_fit(histogram: dict[int, int], capacity: int, most: int | None = None) -> list[list[tuple[int, int]]] | None:
    """Bins as lists of (size, how many), or None where more than `most` bins would be needed.

    Sizes are placed largest first, each into the bin of least remaining room that holds it. What is larger than
    `capacity` fills a bin of its own.
    """
    bins: list[list[tuple[int, int]]] = []
    rooms = Rooms()
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            found = rooms.tightest(size)
            if found is None:
                if len(bins) == most:
                    return None
                found = max(capacity, size), len(bins)
                bins.append([])
            room, place = found
            # The bin stays the tightest as long as it holds one more of this size.
            put = min(left, room // size)
            bins[place].append((size, put))
            left -= put
            if room > put * size:
                rooms.add(room - put * size, place)
    return bins


def level(histogram: dict[int, int], shards: int) -> list[list[tuple[int, int]]]:
    """At most `shards` bins whose largest is as small as best fit makes it, to a part in 4096.

    A group that is larger than an even share of what is left has a bin of its own, so it widens no other.
    """
    rest, free, left, alone = sum(s * n for s, n in histogram.items()), shards, dict(histogram), []
    for size in sorted(histogram, reverse=True):
        while left[size] and free > 1 and size * free >= rest:
            alone.append([(size, 1)])
            left[size] -= 1
            rest, free = rest - size, free - 1
        if left[size]:
            break
    left = {s: n for s, n in left.items() if n}
    if not left:
        return alone
    low = max(-(-rest // free), max(left))
    found, step = best_fit(left, low, free), max(low >> 12, 1)
    if found is None:
        wide = step
        while (found := best_fit(left, low + wide, free)) is None:
            wide *= 2
        under, over = wide // 2, wide
        while over - under > step:
            middle = (under + over) // 2
            made = best_fit(left, low + middle, free)
            under, over, found = (middle, over, found) if made is None else (under, middle, made)
    return alone + found


def _runs(bins: list[list[tuple[int, int]]]) -> list[tuple[int, int, int, int]]:
    """Rows (size, first rank, ranks, shard)."""
    taken: dict[int, int] = {}
    rows = []
    for shard, held in enumerate(bins):
        for size, n in held:
            rows.append((size, taken.get(size, 0), n, shard))
            taken[size] = taken.get(size, 0) + n
    return rows


def shard(
    docs: DataFrame, shards: int = 24, text: str = "text", keep: list[str] | None = None, capacity: int | None = None,
    units: int = UNITS,
) -> DataFrame:
    """Give each document a shard and a slot in it: `keep`, size, text_crc32, shard, slot.

    A document's size is its UTF-8 bytes and 8 more. Documents of equal text are one group, which is never split.
    With `capacity` (bytes of a shard), shards are as few as best fit needs, and `shards` is about how many are
    expected; without it, there are at most `shards`, as even as best fit makes them.

    Groups under a `units`-th of a shard's share are first put together by a hash of their text, so that there are at
    most 2 * shards * units things to pack, whatever the input; only how often each size occurs comes to the
    driver. Things of one size are told apart by rank, and the bounded table of their shards is broadcast. Slots
    are counted in parts of a shard, as a shard has no bound.

    A null text has no bytes and is grouped with the empty one. Rows are documents of their own, also with a repeated
    or null key. `keep` is all columns but the text by default; columns of the result's names are replaced. Shards
    that nothing enters have no rows; no documents give no rows.
    """
    spark = docs.sparkSession
    made = ("size", "text_crc32", "shard", "slot")
    names = [c for c in (docs.columns if keep is None else keep) if c not in made and (keep is not None or c != text)]
    body = plain_text(text)
    rows = stored(
        docs.select(
            *(F.col(c).alias(f"_own_{i}") for i, c in enumerate(names)),
            (F.octet_length(body) + F.lit(ROW_BYTES)).cast("bigint").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(body, 256)).alias("digest"), F.monotonically_increasing_id().alias("row"),
        ),
        "shard-rows",
    )
    whole = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    unit, buckets = -(-whole["bytes"] // (shards * units)), shards * units
    if capacity is not None and capacity < 8 * unit:
        raise ValueError("shards are too many for these units: raise shards or units")
    bucket = F.pmod(F.xxhash64("digest"), F.lit(buckets))
    things = stored(
        rows.groupBy("digest").agg(F.sum("size").alias("size"))
        .select(
            F.when(F.col("size") >= unit, F.col("digest")).alias("digest"), F.when(F.col("size") < unit, bucket).alias("bucket"), "size"
        )
        .groupBy("digest", "bucket").agg(F.sum("size").alias("size")),
        "shard-things",
    )
    histogram = {r["size"]: r["count"] for r in things.groupBy("size").count().collect()}
    bins = level(histogram, shards) if capacity is None else best_fit(histogram, capacity)
    runs = spark.createDataFrame(_runs(bins), "size bigint, first bigint, ranks bigint, shard int")
    rank = F.row_number().over(Window.partitionBy("size").orderBy("digest", "bucket")) - 1
    placed = stored(
        things.withColumn("rank", rank).join(F.broadcast(runs), "size")
        .where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("ranks")))
        .select("digest", "bucket", "shard"),
        "shard-places",
    )
    large = placed.where(F.col("digest").isNotNull()).select("digest", F.col("shard").alias("_large"))
    small = placed.where(F.col("bucket").isNotNull()).select(F.col("bucket").alias("_bucket"), F.col("shard").alias("_small"))
    parts = 16 + whole["n"] // NUMBERED
    sharded = (
        rows.join(F.broadcast(large), "digest", "left").withColumn("_bucket", bucket).join(F.broadcast(small), "_bucket", "left")
        .withColumn("shard", F.coalesce("_large", "_small")).withColumn("_part", F.pmod(F.xxhash64("row"), F.lit(parts)))
        .drop("digest", "_bucket", "_large", "_small")
    )
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sharded.groupBy("shard", "_part").count().select(
        "shard", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before")
    )
    inside = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("row")) - 1
    return sharded.withColumn("_inside", inside).join(starts, ["shard", "_part"]).select(
        *(F.col(f"_own_{i}").alias(c) for i, c in enumerate(names)), "size", "text_crc32", "shard",
        (F.col("_before") + F.col("_inside")).cast(T.LongType()).alias("slot"),
    )
