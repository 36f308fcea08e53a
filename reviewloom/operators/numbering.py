"""Row numbers and running totals over a whole table, without a window over one partition.

Rows are dealt out by ranges of the order, so that every partition follows the one before it. Each partition counts its
rows or sums its values; the totals of the partitions before it, as many numbers as there are partitions, are added to what a
window inside the partition gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from reviewloom.session import durable

PART = "_part"


def _placed(df: DataFrame, order: tuple[Column | str, ...]) -> DataFrame:
    return durable(df.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()))


def _with_offsets(placed: DataFrame, total: Column) -> DataFrame:
    """Add ``_before``: the total of all earlier partitions."""
    before, offsets = 0, []
    for row in sorted(placed.groupBy(PART).agg(total.alias("n")).collect()):
        offsets.append((row[PART], before))
        before += row["n"] or 0
    kind = dict(placed.select(PART, total.over(W.partitionBy(PART)).alias("n")).dtypes)["n"]
    table = placed.sparkSession.createDataFrame(offsets, f"{PART} int, _before {kind}")
    return placed.join(F.broadcast(table), PART)  # one row per partition


def numbered(df: DataFrame, *order: Column | str, name: str = "index") -> DataFrame:
    """Add the place of each row in the given order, from 0. Equal rows get places of their own, in no stated order."""
    rows = _with_offsets(_placed(df, order), F.count(F.lit(1)))
    place = F.row_number().over(W.partitionBy(PART).orderBy(*order)) - 1
    return rows.withColumn(name, place.cast("bigint") + F.col("_before")).drop(PART, "_before")


def running_total(df: DataFrame, value: str, name: str, *order: Column | str) -> DataFrame:
    """Add the sum of ``value`` up to and with each row, in the given order; rows that are equal in it share one sum."""
    rows = _with_offsets(_placed(df, order), F.sum(value))
    return rows.withColumn(name, F.sum(value).over(W.partitionBy(PART).orderBy(*order)) + F.col("_before")).drop(PART, "_before")


def dense_index(df: DataFrame, key: str) -> DataFrame:
    """(key, index): the distinct values of a column numbered from 0 in their order; null is no value.

    Joining on ``index`` gives the way back.
    """
    return numbered(df.select(key).where(F.col(key).isNotNull()).distinct(), key)
