"""Stored signals: partitioned by day and batch, ordered by tenant and resource within files."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import DateType, StringType, StructField, StructType

from beaconry.schemas import SIGNALS, columns
from beaconry.session import matching, remove


def conform(df: DataFrame, signal: str) -> DataFrame:
    """The signal's columns in their types, with missing ones null."""
    present = set(df.columns)
    return df.select(
        *(
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in SIGNALS[signal].fields
        )
    )


def _folder(value: str) -> str:
    """A batch's name as it stands in a path; one that would be escaped there is refused."""
    if not re.fullmatch(r"[\w.\-]+", value):
        raise ValueError(f"a batch's name holds letters, digits, '_', '-' and '.', not {value!r}")
    return value


def write_signal(df: DataFrame, signal: str, path: str, batch: str | None = None) -> None:
    """Append typed rows, or write again those of a batch of the same name.

    Rows are range-partitioned by day, tenant, resource, metric and time, so each file holds a narrow span
    that row-group statistics can skip, and a resource with very many rows is split by time instead
    of filling one task. Trace ids get a bloom filter where the signal has them. A day's folder holds one
    folder of each batch, which a repeat of the batch replaces; without a name each call is a batch of its own.
    A repeat also deletes the batch's folders of days that it has no rows of, before it writes.
    """
    key = ["tenant_id", "resource_id", *(c for c in ("metric",) if c in columns(signal)), "observed_at"]
    rows = conform(df, signal).withColumn("event_date", F.to_date("observed_at"))
    earlier = [] if batch is None else matching(df.sparkSession, f"{path}/event_date=*/batch={_folder(f'b-{batch}')}")
    if earlier:
        days = {str(r[0]) for r in rows.select("event_date").distinct().collect()}  # a row for each day of one batch
        for folder in earlier:
            if folder.split("/event_date=")[-1].split("/")[0] not in days:
                remove(df.sparkSession, folder)
    rows = rows.repartitionByRange("event_date", *key).sortWithinPartitions("event_date", *key)
    rows = rows.withColumn("batch", F.lit(f"own-{uuid.uuid4().hex}" if batch is None else f"b-{batch}"))
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date", "batch")
    if "trace_id" in columns(signal):
        writer = writer.option("parquet.bloom.filter.enabled#trace_id", "true").option(
            "parquet.bloom.filter.fpp#trace_id", "0.001"
        )
    writer.parquet(path)


def sink_signal(rows: DataFrame, signal: str, path: str, progress: str) -> DataStreamWriter:
    """A writer that stores a stream as `write_signal` does; a micro-batch that runs again replaces its rows.

    Batches are named by their number, so a stored signal takes one stream, beside any batch writes.
    """

    def write(batch: DataFrame, number: int) -> None:
        write_signal(batch, signal, path, str(number))

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", progress)


def stored_schema(signal: str) -> StructType:
    return StructType([*SIGNALS[signal].fields, StructField("event_date", DateType()), StructField("batch", StringType())])


def read_signal(spark: SparkSession, signal: str, path: str) -> DataFrame:
    """A stored signal; a window on it prunes days and skips row groups."""
    return spark.read.schema(stored_schema(signal)).parquet(path).drop("batch")


def stream_signal(spark: SparkSession, signal: str, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stored signal as a stream of the files added to it."""
    reader = spark.readStream.schema(stored_schema(signal))
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).drop("batch")
