"""Near-duplicate vectors: sorted passes over random projections, then exact counts within what they connect."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beaconry.llm.common import component_ids, groups_of, roots, stored

#: Sorted passes over labels of up to CROWD vectors and for each doubling beyond, bits of a pass's concatenated
#: hashes, and vectors in half a window.
PASSES, MORE, CROWD, BITS, WINDOW = 12, 2, 1 << 14, 48, 256
#: Windows that a sorted stretch has at least, on average.
STRETCH = 16
#: Vectors of a component that are compared in one step.
BLOCK = 512


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of equal-length lists as unit vectors in double precision."""
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    return x / np.linalg.norm(x, axis=1)[:, None]


def _hashes(batches: Iterator[pa.RecordBatch], passes: int, bits: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Adds a long for each pass: the signs of a vector's projections, as bits in a row."""
    planes: dict[int, np.ndarray] = {}
    weights = np.int64(1) << np.arange(bits - 1, -1, -1, dtype=np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        vectors = batch.column(batch.schema.get_field_index("vector")).to_numpy(zero_copy_only=False)
        keys = np.zeros((batch.num_rows, passes), dtype=np.int64)
        sizes = np.array([len(v) for v in vectors])
        for d in np.unique(sizes):
            if d not in planes:
                planes[d] = np.random.default_rng([seed, int(d)]).standard_normal((int(d), passes * bits))
            at = np.flatnonzero(sizes == d)
            for a in range(0, len(at), 4096):
                some = at[a : a + 4096]
                signs = _unit(vectors[some]) @ planes[d] > 0
                keys[some] = (signs.reshape(len(some), passes, bits) * weights).sum(axis=2)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(keys), pa.list_(pa.int64()))], names=[*batch.schema.names, "keys"])


def _edges(ids: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    root = roots(linked)
    moved = np.flatnonzero(root != np.arange(len(root)))
    return ids[moved], ids[root[moved]]


def _window_batches(batches: Iterator[pa.RecordBatch], least: float, window: int) -> Iterator[pa.RecordBatch]:
    """Edges that connect links among sorted rows: each stretch of `window` rows against itself and the next."""
    for g in groups_of(batches, ["pass", "label", "size"]):
        x = _unit(g["vector"])
        for a in range(0, len(x), window):
            near = slice(a, a + 2 * window)
            a_ids, b_ids = _edges(g["id"][near], x[near] @ x[near].T >= least)
            if len(a_ids):
                yield pa.RecordBatch.from_arrays([pa.array(a_ids), pa.array(b_ids)], names=["a", "b"])


def _count_batches(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Links of each vector within a block of a component, or between two: copies count."""
    for g in groups_of(batches, ["component", "i", "j"]):
        x, copies, side = _unit(g["vector"]), g["copies"].astype(np.float64), g["side"].astype(bool)
        linked = x @ x.T >= least
        if side.any():
            linked &= side[:, None] != side[None, :]
        else:
            np.fill_diagonal(linked, False)
        n = (linked @ copies).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(g["id"]), pa.array(n)], names=["id", "n"])


def near_vectors(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98,
    passes: int | None = None, window: int = WINDOW, seed: int = 7,
) -> DataFrame:
    """(key, n_links, component_id, kept) for each vector; the key must be whole numbers.

    Vectors link when labels are equal and not null and their cosine in double precision is `least` or more.
    Equal vectors of a label are one class. In each pass the classes are ordered by label and by their
    concatenated random hashes, and every one is compared with the `window` to twice `window` rows on
    either side; verified links of all passes are united. The passes need only connect a group: links
    are then counted between all vectors of each connected component, in blocks, so a group
    denser than a window loses none. Two vectors that no pass and no chain of links connects are missed;
    the more passes, the fewer. By default there are `PASSES`, and `MORE` for each doubling of the largest label
    beyond `CROWD` vectors. Hashes are made once, and all passes are one sort.

    Null, zero, ragged or non-finite vectors and null labels link with nothing; vectors of other
    lengths are compared with those of their own. Rows with an equal key are rows of their own; null
    keys link, but name no component. No rows give no rows.
    """
    spark = rows.sparkSession
    values = F.col(vector)
    numbers = F.transform(values, lambda v: v.cast("double"))
    sound = F.coalesce(
        (F.size(values) > 0) & F.forall(numbers, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
        & F.exists(numbers, lambda v: v != 0) & F.col(label).isNotNull(), F.lit(False),
    )
    base = rows.select(F.col(key).cast("bigint").alias("key"), F.col(label).alias("label"), numbers.alias("vector"), sound.alias("sound"))
    classes = stored(
        base.where("sound").groupBy("label", "vector").agg(F.min("key").alias("id"), F.count(F.lit(1)).alias("copies"))
        .withColumn("size", F.size("vector")).where(F.col("id").isNotNull()),
        "vector-classes",
    )

    def hashes(batches):
        from beaconry.llm import embeddings

        yield from embeddings._hashes(batches, passes, BITS, seed)

    def windows(batches):
        from beaconry.llm import embeddings

        yield from embeddings._window_batches(batches, least, window)

    def count(batches):
        from beaconry.llm import embeddings

        yield from embeddings._count_batches(batches, least)

    n, largest = classes.groupBy("label", "size").count().agg(F.sum("count"), F.max("count")).first()
    if passes is None:
        passes = PASSES + MORE * max(0, ((largest or 0) - 1) // CROWD).bit_length()
    fields = classes.select("id", "label", "size", "vector").schema.fields
    hashed = classes.select("id", "label", "size", "vector").mapInArrow(
        hashes, T.StructType([*fields, T.StructField("keys", T.ArrayType(T.LongType()))])
    )
    hashed = stored(hashed, "vector-hashes")
    # A stretch is sorted within one task and has many windows; where ranges end differs from pass to pass.
    order = ["pass", "label", "size", "_key", "id"]
    ranges = min(passes * int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + passes * (n or 0) // (STRETCH * window))
    found = (
        hashed.select("label", "size", "id", "vector", F.posexplode("keys").alias("pass", "_key"))
        .repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("pass", "label", "size", "id", "vector")
        .mapInArrow(windows, "a bigint, b bigint")
    )
    named = stored(component_ids(stored(found.distinct(), "vector-edges")), "vector-components")

    counts = named.groupBy(F.col("component_id").alias("component")).agg(F.count(F.lit(1)).alias("members"))
    sized = named.withColumnRenamed("component_id", "component").join(counts, "component")
    members = classes.join(sized, "id")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    pairs = (
        members.withColumn("blocks", blocks)
        .withColumn("own", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
            (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "copies", "vector",
        )
    )
    links = (
        pairs.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
        .mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    )
    told = classes.join(links, "id", "left").join(named, "id", "left").select(
        "label", "vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component_id", "id").alias("component")
    )
    out = base.where("sound").join(told, ["label", "vector"], "left").select("key", "n", "component").union(
        base.where("not sound").select("key", F.lit(0).cast("bigint"), F.lit(None).cast("bigint"))
    )
    component = F.coalesce("component", "key")
    return out.select(
        F.col("key").alias(key), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"),
    )
