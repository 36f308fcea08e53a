"""Versioned folders of trained models.

A version is written under a number of its own and counts only when its marker file, which names its tables and holds its
parameters, has been written last. Readers take the newest version with a marker, so a run that fails half way
leaves the model as it was.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKER = "marker"


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished versions under ``path``, oldest first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = []
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), f"{MARKER}/_SUCCESS")):
            found.append(int(name.removeprefix("version=")))
    return sorted(found)


def save(spark: SparkSession, path: str, tables: dict[str, DataFrame], params: dict | None = None) -> int:
    """Write the tables and parameters as the next version and return its number."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    taken = [0]
    if fs.exists(folder):
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        taken += [int(n.removeprefix("version=")) for n in names if n.startswith("version=")]
    number = max(taken) + 1
    base = f"{path}/version={number}"
    for name, df in tables.items():
        df.write.parquet(f"{base}/{name}")
    about = json.dumps({"tables": sorted(tables), "params": params or {}})
    spark.createDataFrame([(about,)], "value string").coalesce(1).write.text(f"{base}/{MARKER}")
    return number


def load(spark: SparkSession, path: str, version: int | None = None) -> tuple[dict[str, DataFrame], dict]:
    """Tables and parameters of a version, by default the newest finished one."""
    found = versions(spark, path)
    if not found or version is not None and version not in found:
        raise FileNotFoundError(f"no finished version {'' if version is None else version} of a model in {path}")
    base = f"{path}/version={found[-1] if version is None else version}"
    about = json.loads(spark.read.text(f"{base}/{MARKER}").select(F.col("value")).first()["value"])
    return {name: spark.read.parquet(f"{base}/{name}") for name in about["tables"]}, about["params"]
