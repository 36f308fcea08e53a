"""Readers for raw dumps and stage tables."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom.schemas import META, METRICS, RAW_META, RAW_META_FIELDS, RAW_REVIEW_FIELDS, RAW_REVIEWS, REJECT, REVIEWS


def _literal_lines(schema: T.StructType):
    """Second reader for the few lines the JSON reader rejects: Python literals such as None or True."""
    names = [f.name for f in schema.fields if f.name != REJECT]
    numbers = {f.name for f in schema.fields if isinstance(f.dataType, T.DoubleType)}

    def parse(line: str) -> dict:
        try:
            record = ast.literal_eval(line)
            if not isinstance(record, dict):
                raise ValueError("not a record")
            row = {n: record.get(n) for n in names}
            for n in names:
                if row[n] is not None:
                    row[n] = float(row[n]) if n in numbers else _as_text(row[n])
            return {**row, REJECT: None}
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return {**{n: None for n in names}, REJECT: line}

    def parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [parse(line) for line in batch[REJECT]]
            yield pd.DataFrame(rows, columns=[f.name for f in schema.fields])

    return parse_batches


def _as_text(value: object) -> str:
    import json

    return value if isinstance(value, str) else json.dumps(value)


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Rows and rejected lines of a line-JSON dump, with double or single quotes or Python literals."""
    options = {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": REJECT, "allowSingleQuotes": "true",
        "allowBackslashEscapingAnyCharacter": "true",
    }
    lines = spark.read.text(path).where(F.trim("value") != "")
    raw = lines.select(F.from_json("value", schema, options).alias("r")).select("r.*")
    good = raw.where(F.col(REJECT).isNull())
    second = raw.where(F.col(REJECT).isNotNull()).mapInPandas(_literal_lines(schema), schema)
    rows = good.unionByName(second.where(F.col(REJECT).isNull())).drop(REJECT)
    return rows, second.where(F.col(REJECT).isNotNull()).select(F.col(REJECT).alias("line"))


def flat_categories(text: Column) -> Column:
    """Category names from text such as [["A", "B"]] or ['A', 'B']: flat, in order."""
    nested = F.from_json(text, "array<array<string>>", {"allowSingleQuotes": "true"})
    flat = F.from_json(text, "array<string>", {"allowSingleQuotes": "true"})
    is_nested = F.regexp_like(text, F.lit(r"^\s*\[\s*\["))
    return F.when(is_nested, F.flatten(nested)).otherwise(flat)


def nested_category(text: Column, outer: int = 0, inner: int = 1) -> Column:
    """One element of a nested category list; null where there is none."""
    nested = F.from_json(text, "array<array<string>>", {"allowSingleQuotes": "true"})
    return F.get(F.get(nested, outer), inner)


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    rows, _ = read_records(spark, path, RAW_REVIEWS)
    return rows.select(*[F.col(a).alias(b) for a, b in RAW_REVIEW_FIELDS.items()])


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """Item metadata; one dump calls the categories ``category``."""
    rows, _ = read_records(spark, path, RAW_META)
    rows = rows.withColumn("categories", flat_categories(F.coalesce("categories", "category")))
    return rows.select(*[F.col(a).alias(b) for a, b in RAW_META_FIELDS.items()])


def load_dataset(
    spark: SparkSession, reviews_path: str, meta_path: str | None = None
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Reviews, and the metadata too if its path is given."""
    reviews = read_reviews(spark, reviews_path)
    return reviews if meta_path is None else (reviews, read_meta(spark, meta_path))


def read_csv(spark: SparkSession, path: str, schema: T.StructType = REVIEWS) -> DataFrame:
    """CSV import; review texts hold line breaks and quotes."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metrics file; its first name may start with a byte-order mark, so columns go by position."""
    return spark.read.schema(METRICS).option("header", True).option("enforceSchema", True).csv(path)


def read_stage(spark: SparkSession, path: str, category: str | None = None) -> DataFrame:
    """Stage table, or one category of it: only that folder is read."""
    df = spark.read.parquet(path)
    return df if category is None else df.where(F.col("category") == category)


def read_jdbc(spark: SparkSession, url: str, table: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """Table in a database; ``partition`` = (column, low, high, parts) reads it in parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition:
        column, low, high, parts = partition
        reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.load()


__all__ = [
    "META", "flat_categories", "load_dataset", "nested_category", "read_csv", "read_jdbc", "read_meta",
    "read_metrics", "read_records", "read_reviews", "read_stage",
]
