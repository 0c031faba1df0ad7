"""Tumbling rollups as a stream of partial states, compacted by generations.

Each micro-batch is aggregated on its own and written as one partition of the rollup's parts, named by the
batch. Readers merge the partials, so a row that comes late is one more partial and nothing waits
for a watermark. A batch that is run again overwrites its own partition.

`compact` merges parts into a generation, and then writes one small commit record that says up to which batch the
generation holds everything. Readers take the last committed generation and the parts beyond it, so nothing counts
twice, and a generation whose commit was never written is as if it were not there. `forget` deletes what no
reader of the last two generations needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from beaconry.operators.rollups import merge_states
from beaconry.session import remove

_COMMIT = "upto bigint"


def _parts(path: str) -> str:
    return f"{path}/parts"


def _generation(path: str, number: int) -> str:
    return f"{path}/generations/generation={number}"


def _commit(path: str, number: int) -> str:
    return f"{path}/commits/generation={number}"


def rollup_stream(
    rows: DataFrame, rollup: Callable[[DataFrame], DataFrame], path: str, progress: str
) -> DataStreamWriter:
    """A writer that keeps `path` holding the partial states of a stream."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rollup(batch).write.mode("overwrite").parquet(f"{_parts(path)}/batch_id={batch_id}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", progress)


def committed(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(generation, the last batch it holds) of each commit, the newest first."""
    try:
        commits = spark.read.schema(f"{_COMMIT}, generation bigint").parquet(f"{path}/commits")
        return sorted(((r["generation"], r["upto"]) for r in commits.collect()), reverse=True)  # a row for each compaction kept
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise


def _partials(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None, int, int]:
    """Parts that no committed generation holds, the generation's states, its number and its last batch."""
    parts = spark.read.option("basePath", _parts(path)).parquet(_parts(path))
    number, upto = next(iter(committed(spark, path)), (0, -1))
    states = spark.read.parquet(_generation(path, number)).drop("event_date") if number else None
    return parts.where(F.col("batch_id") > upto), states, number, upto


def read_partials(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The rollup so far, partials of one key merged. `kind` names its states."""
    parts, states, _, _ = _partials(spark, path)
    rows = parts.drop("batch_id")
    return merge_states(kind, rows if states is None else rows.unionByName(states))


def compact(spark: SparkSession, path: str, kind: str, leave: int = 1) -> bool:
    """Merge all parts but the newest `leave` into a new generation; whether there was anything to merge.

    The newest batch may be running, or run again, so it stays a part of its own. The stream goes on meanwhile. What
    a run that failed before its commit has written is overwritten by the next. One compaction runs at a time.
    """
    parts, states, number, upto = _partials(spark, path)
    newest = parts.agg(F.max("batch_id")).first()[0]
    if newest is None or newest - leave <= upto:
        return False
    rows = parts.where(F.col("batch_id") <= newest - leave).drop("batch_id")
    merged = merge_states(kind, rows if states is None else rows.unionByName(states)).withColumn("event_date", F.to_date("bucket"))
    merged.repartitionByRange("event_date", *merged.columns[:2]).write.mode("overwrite").partitionBy("event_date").parquet(
        _generation(path, number + 1)
    )
    spark.createDataFrame([(newest - leave,)], _COMMIT).coalesce(1).write.mode("overwrite").parquet(_commit(path, number + 1))
    return True


def forget(spark: SparkSession, path: str) -> None:
    """Delete generations before the last two, and parts that both of these hold; readers of either go on."""
    found = committed(spark, path)
    if len(found) < 2:
        return
    (last, _), (before, upto) = found[:2]
    for number, _ in found[2:]:
        # The record first: a generation without one is not read.
        remove(spark, _commit(path, number))
        remove(spark, _generation(path, number))
    held = spark.read.parquet(_parts(path)).where(F.col("batch_id") <= upto).select("batch_id").distinct()
    for row in held.collect():  # a row for each batch since the last time
        remove(spark, f"{_parts(path)}/batch_id={row['batch_id']}")
