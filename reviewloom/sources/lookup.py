"""Lookup tables: catalogue tables that are written once and read by key.

A table is partitioned by the columns whose values are replaced as a whole, bucketed by the key and sorted within its buckets.
A lookup names the partition and the key, so the scan opens the files of one bucket, and in these only the row groups that
their ranges and bloom filters leave. Grouping by the key, or joining on it, needs no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.session import checkpoint_dir, durable

ROWS_PER_BUCKET = 1_000_000
LEAST_BUCKETS = 8


def buckets_for(rows: int) -> int:
    return max(LEAST_BUCKETS, math.ceil(rows / ROWS_PER_BUCKET))


def store(
    df: DataFrame, name: str, key: str, order: Sequence[str] = (), replace: Sequence[str] = (), *, buckets: int | None = None,
    path: str | None = None,
) -> DataFrame:
    """Write ``df`` to the catalogue table ``name`` and return the table.

    If the table exists, the values of the ``replace`` columns that occur in ``df`` are replaced and others are left as they
    are; without such columns the whole table is. A new table gets as many buckets as its rows ask for; they hold
    for its life. ``path`` is where a new table's files go, by default a folder in the shared checkpoint folder.
    """
    spark = df.sparkSession
    rows = durable(df)
    if spark.catalog.tableExists(name):
        columns = spark.table(name).columns
        if set(columns) != set(rows.columns):
            raise ValueError(f"{name} has the columns {columns}, not {rows.columns}")
        _laid_out(rows.select(columns), key, order, _buckets(spark, name)).write.option(
            "partitionOverwriteMode", "dynamic" if replace else "static"
        ).insertInto(name, overwrite=True)
        return spark.table(name)
    n = rows.count()
    buckets = buckets or buckets_for(n)
    kept = [c for c in rows.columns if c not in replace]
    writer = (
        _laid_out(rows.select(*kept, *replace), key, order, buckets)
        .write.format("parquet").mode("overwrite")
        .option("path", path or f"{checkpoint_dir(spark)}/lookup/{name}")
        .option(f"parquet.bloom.filter.enabled#{key}", "true")
        .option(f"parquet.bloom.filter.expected.ndv#{key}", str(max(1, n // buckets)))
        .bucketBy(buckets, key).sortBy(key, *order)
    )
    (writer.partitionBy(*replace) if replace else writer).saveAsTable(name)
    return spark.table(name)


def _laid_out(rows: DataFrame, key: str, order: Sequence[str], buckets: int) -> DataFrame:
    """One task per bucket, so that a bucket is one file per partition."""
    return rows.repartition(buckets, key).sortWithinPartitions(key, *order)


def _buckets(spark: SparkSession, name: str) -> int:
    described = spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Num Buckets'").first()
    return int(described["data_type"])


def find(spark: SparkSession, name: str, order: Sequence[str] = (), limit: int | None = None, **values: object) -> DataFrame:
    """Rows of the table ``name`` with these column values, in order. Values travel as parameters, never as SQL text."""
    rows = spark.table(name)
    for column, value in values.items():
        rows = rows.where(F.col(column) == F.lit(value))
    rows = rows.orderBy(*order) if order else rows
    return rows if limit is None else rows.limit(limit)
