"""A Merkle manifest of a dataset: leaves, roots, and proofs found by pointer jumping."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beaconry.llm.common import stored

#: Levels that one step climbs: a block of 2^SPAN nodes is hashed in one task.
SPAN = 8
#: Bytes of a step of a proof: where the sibling stands (0 nowhere, 1 before, 2 after), and its digest.
STEP = 33
#: The tree over the roots of groups, and the most groups of which a table is broadcast.
TOP, FEW = -1, 100_000


def leaf_of(values: list[Column]) -> Column:
    """Digest (hex) of values one after another, each `-` if null, else its UTF-8 byte count, `:` and itself."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def _place(proof: Column, i: Column) -> Column:
    return F.hex(proof.substr(i * STEP + 1, F.lit(1)))


def _sibling(proof: Column, i: Column) -> Column:
    return F.lower(F.hex(proof.substr(i * STEP + 2, F.lit(STEP - 1))))


def _steps(proof: Column) -> Column:
    """Numbers of a proof's steps, from 0."""
    n = F.octet_length(proof) / STEP
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), n.cast("int") - 1))


def siblings(proof: Column) -> Column:
    """Digests (hex) of a proof's siblings, one after another."""
    return F.array_join(F.transform(_steps(proof), lambda i: F.when(_place(proof, i) == "00", "").otherwise(_sibling(proof, i))), "")


def fold(leaf: Column, proof: Column) -> Column:
    """The root (hex) that a leaf (hex) and a proof lead to."""

    def climb(own: Column, i: Column) -> Column:
        place, other = _place(proof, i), _sibling(proof, i)
        return F.sha2(F.when(place == "00", own).when(place == "01", F.concat(other, own)).otherwise(F.concat(own, other)), 256)

    return F.aggregate(_steps(proof), leaf, climb)


def _climb(hashes: list[bytes], levels: int) -> tuple[list[bytes], bytes]:
    """Segments of proofs over `levels` levels for each node (hex digests) of a block, and what the block becomes."""
    tiers = [hashes]
    for _ in range(levels):
        now = tiers[-1]
        tiers.append([hashlib.sha256(b"".join(now[i : i + 2])).hexdigest().encode() for i in range(0, len(now), 2)])
    segments = [b""]
    for now in tiers[-2::-1]:
        raw = [bytes.fromhex(h.decode()) for h in now]
        steps = [
            (b"\1" + raw[i - 1] if i & 1 else b"\2" + raw[i + 1] if i + 1 < len(raw) else bytes(STEP)) + segments[i >> 1]
            for i in range(len(raw))
        ]
        segments = steps
    return segments, tiers[-1][0]


def _step_batches(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Nodes sorted by (tree, pos), with the segment up to their block's top; the first of a block carries that top."""

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        tree, pos, total = (table.column(n).to_numpy() for n in ("tree", "pos", "total"))
        block = pos >> span
        cuts = [0, *(np.flatnonzero((tree[1:] != tree[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), len(pos)]
        hashes = [h.hex().encode() for h in table.column("hash").to_pylist()]
        segments, tops = [], []
        for a, b in zip(cuts, cuts[1:], strict=False):
            own, top = _climb(hashes[a:b], min(span, int(total[a] - 1).bit_length()))
            segments += own
            tops += [bytes.fromhex(top.decode()), *[None] * (b - a - 1)]
        out = table.append_column("segment", pa.array(segments, pa.binary())).append_column("top", pa.array(tops, pa.binary()))
        yield from out.combine_chunks().to_batches()

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = now if rest is None else pa.concat_tables([rest, now])
        tree, block = now.column("tree").to_numpy(), now.column("pos").to_numpy() >> span
        cut = int(np.flatnonzero((tree != tree[-1]) | (block != block[-1])).max(initial=-1)) + 1
        if cut:
            yield from done(now.slice(0, cut))
        rest = now.slice(cut)
    if rest is not None and rest.num_rows:
        yield from done(rest)


def _step(nodes: DataFrame, span: int, name: str) -> DataFrame:
    schema = T.StructType([*nodes.schema.fields, T.StructField("segment", T.BinaryType()), T.StructField("top", T.BinaryType())])

    def run(batches):
        from beaconry.llm import manifest

        yield from manifest._step_batches(batches, span)

    block = F.shiftright("pos", span)
    return stored(nodes.repartition("tree", block).sortWithinPartitions("tree", "pos").mapInArrow(run, schema), name)


def _positions(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """`rows` with `at`, their place from 0 in the whole order.

    Rows are range-partitioned and sorted; only a count for each partition is summed up and broadcast.
    """
    own = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), name)
    part = F.shiftright("_id", 33)
    counts = own.groupBy(part.alias("_part")).count().collect()  # a row for each partition
    starts, sum_ = [], 0
    for r in sorted(counts, key=lambda r: r["_part"]):
        starts.append((r["_part"], sum_))
        sum_ += r["count"]
    first = rows.sparkSession.createDataFrame(starts, "_part bigint, _start bigint")
    inside = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return own.withColumn("_part", part).join(F.broadcast(first), "_part").withColumn("at", F.col("_start") + inside).drop("_part", "_start", "_id")


def _grow(nodes: DataFrame, most: int, span: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Steps from nodes up to the tops of their trees, none of which has over `most` nodes; and (tree, hash) of these tops."""
    steps, tops, number = [], [], 0
    while True:
        made = _step(nodes, span, f"manifest-{name}-{number}").withColumn("step", F.lit(number))
        steps.append(made)
        first = made.where(F.col("top").isNotNull())
        tops.append(first.where(F.col("total") <= 1 << span).select("tree", F.col("top").alias("hash")))
        if most <= 1 << span:
            return steps, reduce(DataFrame.unionByName, tops)
        nodes = first.where(F.col("total") > 1 << span).select(
            "tree", F.shiftright("pos", span).alias("pos"), F.shiftright(F.col("total") + ((1 << span) - 1), span).alias("total"), F.col("top").alias("hash")
        )
        most, number = (most + (1 << span) - 1) >> span, number + 1


def manifest(
    rows: DataFrame, fields: list[str], group: str, key: str, keep: list[str] | None = None, span: int = SPAN
) -> DataFrame:
    """Leaf, roots and proof of each row: `keep`, leaf, subroot, root (hex digests) and proof (binary, see `fold`).

    A leaf is the digest of the row's `fields`. Leaves of a `group` ascend by `key`, and every two neighbours become
    the digest of both, an odd last one the digest of itself, until one is left, the subroot; subroots, ordered by
    group, become the root in the same way. A null group or key is the least. Ties of a key are ordered by leaf, so
    equal rows are interchangeable.

    Blocks of 2^`span` nodes are hashed as one, which gives each node the segment of siblings up to the node
    `span` levels above it. Those nodes are then joined with themselves: a node's segment is followed by that of its
    ancestor, and its ancestor's ancestor becomes its own, so that the distance doubles until all are at the root; the
    leaves join last. Nodes above the leaves are a 2^`span`-th of them.

    `keep` is all columns by default; columns of the result's names are replaced. No rows give no rows.
    """
    made = ("leaf", "subroot", "root", "proof")
    names = [c for c in (rows.columns if keep is None else keep) if c not in made]
    leaves = stored(
        rows.select(
            *(F.col(c).alias(f"_own_{i}") for i, c in enumerate(names)), F.col(group).alias("_group"), F.col(key).alias("_key"),
            F.unhex(leaf_of([F.col(c) for c in fields])).alias("hash"),
        ),
        "manifest-leaves",
    )
    order = [F.col("_group").asc_nulls_first(), F.col("_key").asc_nulls_first(), F.col("hash").asc()]
    ranked = _positions(leaves, order, "manifest-order")
    counted = ranked.groupBy("_group").agg(F.min("at").alias("_first"), F.count(F.lit(1)).alias("total"))
    groups = stored(
        _positions(counted, [F.col("_first").asc()], "manifest-groups").select(F.col("_group").alias("_of"), "_first", "total", F.col("at").alias("tree")),
        "manifest-trees",
    )
    sizes = groups.agg(F.max("total").alias("most"), F.count(F.lit(1)).alias("groups")).first()
    few = F.broadcast if sizes["groups"] <= FEW else lambda table: table
    nodes = ranked.join(few(groups), F.col("_group").eqNullSafe(F.col("_of"))).select(
        *(f"_own_{i}" for i in range(len(names))), "tree", (F.col("at") - F.col("_first")).alias("pos"), "total", "hash"
    )
    low, subroots = _grow(nodes, sizes["most"] or 0, span, "group")
    top, root = _grow(
        subroots.select(F.lit(TOP).cast("bigint").alias("tree"), F.col("tree").alias("pos"), F.lit(sizes["groups"]).cast("bigint").alias("total"), "hash"),
        sizes["groups"], span, "top",
    )
    last = F.col("total") <= 1 << span
    above = F.when(~last, F.struct("tree", (F.col("step") + 1).alias("step"), F.shiftright("pos", span).alias("pos")))
    top_leaf = F.struct(F.lit(TOP).cast("bigint").alias("tree"), F.lit(0).alias("step"), F.col("tree").alias("pos"))
    held = ["tree", "step", "pos", "segment"]
    paths = reduce(
        DataFrame.unionByName,
        [s.select(*held, F.coalesce(above, top_leaf).alias("up")) for s in low[1:]] + [s.select(*held, above.alias("up")) for s in top],
    )
    distance = 1
    while distance < len(low) - 1 + len(top):
        paths = stored(paths, "manifest-paths")
        # An ancestor `distance` steps up, as nodes were first, is at that step of its group or in the top tree.
        high = paths.where((F.col("step") >= distance) | (F.col("tree") == TOP)).select(
            F.struct("tree", "step", "pos").alias("up"), F.col("segment").alias("_more"), F.col("up").alias("_next")
        )
        paths = paths.join(high, "up", "left").select(
            "tree", "step", "pos", F.concat("segment", F.coalesce("_more", F.lit(b""))).alias("segment"), F.col("_next").alias("up")
        )
        distance *= 2
    # Roots of groups are named on the few nodes above leaves, as a join of leaves on the tree would have one key a group.
    roots = subroots.select(F.col("tree").alias("_tree"), F.col("hash").alias("_subroot"))
    of = F.when(F.col("tree") == TOP, F.when(F.col("step") == 0, F.col("pos"))).otherwise(F.col("tree"))
    paths = stored(paths, "manifest-paths").withColumn("_tree", of).join(few(roots), "_tree").select(
        F.struct("tree", "step", "pos").alias("up"), F.col("segment").alias("_more"), "_subroot"
    )
    return (
        low[0].withColumn("up", F.coalesce(above, top_leaf)).join(paths, "up")
        .crossJoin(F.broadcast(root.select(F.col("hash").alias("_root"))))  # one row
        .select(
            *(F.col(f"_own_{i}").alias(c) for i, c in enumerate(names)), F.lower(F.hex("hash")).alias("leaf"),
            F.lower(F.hex("_subroot")).alias("subroot"), F.lower(F.hex("_root")).alias("root"),
            F.concat("segment", "_more").alias("proof"),
        )
    )
