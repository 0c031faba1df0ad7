"""What the corpus operators share: folds, tables kept in the shared folder, tasks over text."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.operators.graph import components
from beaconry.session import work_folder


#: Bytes that an entry of a table of words takes beside the word: two objects and its place.
ENTRY = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, parts: int) -> Column:
    """CRC-32 of the key's text, modulo `parts`; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as a table in the shared folder and read again, so that its lineage ends there."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plain_text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def sampled(rows: DataFrame, most: int, key: str, group: str | None = None) -> DataFrame:
    """About `most` rows (or as many of each value of `group`), chosen by a hash of `key`; all where there are fewer.

    The values of `group` must be few, such as languages: their counts come back as a row for each.
    """
    share = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    kept = F.try_divide(F.lit(float(most)), F.count(F.lit(1))).alias("_share")
    if group is None:
        chosen = rows.crossJoin(F.broadcast(rows.agg(kept)))  # one row
    else:
        chosen = rows.join(F.broadcast(rows.groupBy(group).agg(kept)), group)
    return chosen.where(share < F.col("_share")).drop("_share")


def slices(texts: list, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Stretches [start, stop) of about `size` characters, each at least one text."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= size:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


class Kept(dict):
    """What `make` gives for byte strings, made once; starts anew when entries take about `most` bytes.

    One task owns it, so that its memory goes back when the task ends.
    """

    def __init__(self, make: Callable[[bytes], object], most: int = 32 << 20):
        super().__init__()
        self.make, self.most, self.held = make, most, 0

    def __missing__(self, word: bytes) -> object:
        self.held += len(word) + ENTRY
        if self.held > self.most:
            self.clear()
            self.held = len(word) + ENTRY
        value = self[word] = self.make(word)
        return value


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """`run` over a task's batches, after which the Python worker gives back to the system what the task held.

    Workers are reused, and what their allocators keep for later would count on top of the next task's and the JVM's needs.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from beaconry.llm.common import give_back

        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def give_back() -> None:
    """Collect cycles, and hand pages that are free in Arrow's pool and in the C library's to the system, where it can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Runs of equal keys in sorted batches, each as arrays by column name, wherever batches end."""
    rest: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
        if rest is not None:
            now = {n: np.concatenate([rest[n], now[n]]) for n in now}
        change = np.zeros(len(now[keys[0]]) - 1, dtype=bool)
        for k in keys:
            change |= now[k][1:] != now[k][:-1]
        cuts = np.flatnonzero(change) + 1
        start = 0
        for cut in cuts:
            yield {n: a[start:cut] for n, a in now.items()}
            start = cut
        rest = {n: a[start:] for n, a in now.items()}
    if rest is not None:
        yield rest


def roots(linked: np.ndarray) -> np.ndarray:
    """For each node of a symmetric boolean matrix, the least node it is connected with."""
    n = len(linked)
    label = np.arange(n, dtype=np.int32)
    while True:
        best = np.where(linked, label[None, :], np.int32(n)).min(axis=1, initial=n)
        best = np.minimum(best, label)
        best = np.minimum(best, best[best])
        if (best == label).all():
            return label
        label = best


def component_ids(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b) of long ids, as (id, component_id): the least id of each."""
    one = F.lit("").alias("tenant_id")
    found = edges.select(one, F.col("a").alias("source_id"), F.col("b").alias("target_id"))
    nodes = found.select("tenant_id", F.col("source_id").alias("id")).union(
        found.select("tenant_id", F.col("target_id").alias("id"))
    )
    return components(nodes, found).select("id", "component_id")
