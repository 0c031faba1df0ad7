"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job here relies on. All are runtime SQL settings, so they can be applied to a
# session somebody else built: UTC for bucket arithmetic, and skew handling that is allowed to
# add a shuffle when one key holds a large share of the rows.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def build_session(app: str = "beaconry", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def _checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate data.

    It is the one the cluster names in `spark.checkpoint.dir`. Only a local session without that
    setting gets a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
            folder = tempfile.mkdtemp(prefix="beaconry-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise `df` in the checkpoint folder so an iterative plan does not grow."""
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of whatever store Spark writes to, if it is there."""
    place, store = _hadoop(spark, path)
    store.delete(place, True)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Folders and files of that store whose paths match a pattern."""
    place, store = _hadoop(spark, pattern)
    return [found.getPath().toString() for found in store.globStatus(place) or ()]


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, for a stream's output and progress."""
    return f"{_checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
