"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split hot keys of a join even when the next step then needs one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(app: str = "reviewloom", master: str | None = None, **conf: str) -> SparkSession:
    """Start or reuse a session with the settings the operators are written for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for lineage cuts: the one the cluster names, or a scratch folder in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        named = tempfile.mkdtemp(prefix="reviewloom-checkpoint-")
    sc.setCheckpointDir(named)
    return named


_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()  # of the tables of ``durable``
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a statement go when it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def durable(df: DataFrame, *partition_by: str, compression: str | None = None) -> DataFrame:
    """Compute ``df`` once into a table in the checkpoint folder and read it from there.

    A lost executor then costs no recomputation, the plan starts anew, and later steps read only the
    columns and the ``partition_by`` values they need. Without ``compression`` it is the session's. What was
    shuffled for the table is removed once it is written, so iterations hold the files of one step only.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if compression:
        writer = writer.option("compression", compression)
    with _shuffles_removed(spark):
        writer.parquet(path)
    table = spark.read.schema(df.schema).parquet(path).select(df.columns)
    _paths[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``durable`` that nothing reads any more, such as the last round's state once the next one is written."""
    for table in tables:
        if path := _paths.pop(table, None):
            session = table.sparkSession._jsparkSession
            folder = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(session.sessionState().newHadoopConf()).delete(folder, True)
