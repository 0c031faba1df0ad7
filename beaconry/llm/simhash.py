"""SimHash near-duplicates, found through tables of distances to reference fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beaconry.llm.common import columns, component_ids, groups_of, released, roots, stored

#: Reference fingerprints (multiples of the golden ratio's 64-bit fraction, mixed), and the parts of a fingerprint.
PIVOTS = 16
PARTS = 6
#: Rows of one bucket that are compared in one step; larger buckets are compared as pairs of such blocks.
BLOCK = 1536


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints: outputs of a 64-bit mixing function, as signed numbers."""
    out = []
    for i in range(1, n + 1):
        z = (i * 0x9E3779B97F4A7C15) % 2**64
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = ((z ^ (z >> shift)) * by) % 2**64
        z ^= z >> 31
        out.append(z - 2**64 if z >= 2**63 else z)
    return out


def fingerprint(words: list[bytes], shingle: int = 3, seed: int = 42) -> int:
    """Bits set in over half the shingles' hashes; zero for no words."""
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    n = len(words) - shingle + 1
    hashes = np.fromiter(
        (digest(join(s), seed) for s in zip(*(words[i:] for i in range(shingle)), strict=False)), dtype="<u8", count=n
    )
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, n, 1 << 15):
        part = hashes[a : a + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(key, fp): the SimHash of each whole text over word shingles, as a signed 64-bit number.

    A-Z are lowered and words end at ASCII white space; shorter texts are one shingle, and null or
    empty ones have the fingerprint zero. Every row gives one row.
    """
    kind = docs.schema[key].dataType

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from beaconry.llm.simhash import fingerprint

        for batch in batches:
            (texts,) = columns(batch, text)
            found = np.array([fingerprint((t or "").encode().lower().split(), shingle, seed) for t in texts], dtype=np.uint64)
            ids = batch.column(batch.schema.get_field_index(key))
            yield pa.RecordBatch.from_arrays([ids, pa.array(found.view(np.int64))], names=[key, "fp"])

    schema = T.StructType([T.StructField(key, kind), T.StructField("fp", T.LongType())])
    return docs.select(key, text).mapInArrow(released(scan), schema)


def _masks(parts: int) -> list[int]:
    cuts = [64 * i // parts for i in range(parts + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [m - 2**64 if m >= 2**63 else m for m in masks]


def _add(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def pivot_tables(prints: DataFrame, within: int = 3, parts: int = PARTS, n_pivots: int = PIVOTS) -> DataFrame:
    """Rows (bucket, id, fp, t0, t1) of distinct fingerprints (id, fp).

    The table of a fingerprint has its distances to `n_pivots` reference fingerprints, part by part.
    Two fingerprints that differ in `within` bits at most agree on all distances of at least
    parts - within parts, so rows whose tables agree on some choice of that many parts meet in a
    bucket. t0 and t1 hold the distances over all parts, a byte each.
    """
    masks, marks = _masks(parts), pivots(n_pivots)
    near = [[F.bit_count(F.col("fp").bitwiseXOR(F.lit(p)).bitwiseAND(F.lit(m))) for m in masks] for p in marks]
    tabled = prints.select(
        "id", "fp", *(F.xxhash64(*(near[j][i] for j in range(n_pivots))).alias(f"_p{i}") for i in range(parts)),
        *(
            _add([F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("bigint"), 8 * j) for j, p in enumerate(marks[a : a + 8])]).alias(f"t{a // 8}")
            for a in range(0, n_pivots, 8)
        ),
    )
    keys = F.array(*(F.xxhash64(F.lit(n), *(F.col(f"_p{i}") for i in c)) for n, c in enumerate(combinations(range(parts), parts - within))))
    return tabled.select(F.explode(keys).alias("bucket"), "id", "fp", *(f"t{a // 8}" for a in range(0, n_pivots, 8)))


def _verified(left: dict, right: dict, tables: list[str], within: int) -> np.ndarray:
    """Which pairs pass the tables and then the fingerprints, as a boolean matrix."""
    passed = np.ones((len(left["fp"]), len(right["fp"])), dtype=bool)
    for t in tables:
        a, b = (x[t].astype(np.int64).view(np.uint8).reshape(-1, 8).astype(np.int8) for x in (left, right))
        for j in range(8):
            passed &= np.abs(a[:, None, j] - b[None, :, j]) <= within
    rows, cols = np.nonzero(passed)
    # Unsigned, as numpy counts the bits of a signed number's magnitude.
    far = np.bitwise_count((left["fp"].astype(np.int64)[rows] ^ right["fp"].astype(np.int64)[cols]).view(np.uint64)) > within
    passed[rows[far], cols[far]] = False
    return passed


def _tree(group: dict, tables: list[str], within: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) that connect what links within a bucket's block, or between its two blocks."""
    side = group["side"].astype(bool)
    if side.any():
        left, right = ({n: a[m] for n, a in group.items()} for m in (~side, side))
        met = _verified(left, right, tables, within)
        n = len(left["fp"])
        linked = np.zeros((n + len(right["fp"]),) * 2, dtype=bool)
        linked[:n, n:], linked[n:, :n] = met, met.T
        ids = np.concatenate([left["id"], right["id"]])
    else:
        linked, ids = _verified(group, group, tables, within), group["id"]
    root = roots(linked)
    moved = np.flatnonzero(root != np.arange(len(root)))
    return ids[moved], ids[root[moved]]


def edges(prints: DataFrame, within: int = 3) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints (id, fp) linked by `within` or fewer bits.

    Rows of a bucket are compared in blocks of bounded size: pairs whose tables differ by more than
    `within` in any coordinate are discarded, the rest verified, and only edges that connect are
    returned, so a dense bucket gives no more edges than a block has rows.
    """
    rows = pivot_tables(prints, within)
    tables = [c for c in rows.columns if c.startswith("t")]
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int")
    # Spark sizes what was exploded by the file it came from, and would send it whole through the driver.
    met = (
        rows.hint("merge").join(counts, "bucket")
        .withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
            (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "fp", *tables,
        )
    )

    def verify(batches):
        from beaconry.llm.simhash import _tree

        held_a, held_b, count = [], [], 0
        for g in groups_of(batches, ["bucket", "i", "j"]):
            if len(g["id"]) < 2:
                continue
            a, b = _tree(g, tables, within)
            if len(a):
                held_a.append(a)
                held_b.append(b)
                count += len(a)
            if count > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held_a)), pa.array(np.concatenate(held_b))], names=["a", "b"])
                held_a, held_b, count = [], [], 0
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held_a)), pa.array(np.concatenate(held_b))], names=["a", "b"])

    return (
        met.repartition("bucket", "i", "j")
        .sortWithinPartitions("bucket", "i", "j", "fp")
        .mapInArrow(released(verify), "a bigint, b bigint")
        .distinct()
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", within: int = 3) -> DataFrame:
    """(key, fingerprint, component_id) for each document; the key may be of any type with an order.

    Documents with one fingerprint are one class. Fingerprints link at `within` or fewer differing bits, and a
    component is all that links reach, known by its least key. No link is lost. Texts that are null, empty or white
    space share the fingerprint zero. Rows that share a key are documents of their own; so are those with a null key,
    but it names no component that has another. No documents give no rows.
    """
    prints = stored(fingerprints(docs.select(key, text), key, text), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min(key).alias("least")), "fingerprint-classes")
    linked = stored(edges(classes.select(F.col("fp").alias("id"), "fp"), within), "fingerprint-links")
    named = component_ids(linked).select(F.col("id").alias("fp"), F.col("component_id").alias("_of"))
    whole = classes.join(named, "fp", "left").withColumn("_of", F.coalesce("_of", "fp"))
    labelled = whole.join(whole.groupBy("_of").agg(F.min("least").alias("component_id")), "_of").select("fp", "component_id")
    # Nor are fingerprints, which grow with the documents, sent by the size of their compressed file.
    return prints.hint("merge").join(labelled, "fp").select(
        key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
