"""Sinks for stage tables, recommendations and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_stage(df: DataFrame, path: str, category: str = "category") -> None:
    """Replace the categories that occur in ``df`` and leave the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(category).parquet(path)


def write_recommendations(df: DataFrame, path: str) -> None:
    """Store lists per category and algorithm; running an algorithm again replaces its lists.

    Rows are clustered by user within a partition's files, so that a lookup by user skips row groups.
    """
    (
        df.repartition("category", "algorithm", "user_id")
        .sortWithinPartitions("category", "algorithm", "user_id", "item_rank")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("category", "algorithm")
        .parquet(path)
    )


def append_table(df: DataFrame, name: str, *partition_by: str) -> None:
    """Append to a catalogue table."""
    writer = df.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(name)


def append_jdbc(df: DataFrame, url: str, table: str, **options: str) -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode("append").save()


def write_vectors(df: DataFrame, path: str) -> None:
    """(kind, tag, vec), one folder per kind."""
    df.write.mode("overwrite").partitionBy("kind").parquet(path)
