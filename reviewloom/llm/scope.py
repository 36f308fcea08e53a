"""Small pieces that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; null for a null key."""
    return F.crc32(F.col(key).cast("string")) % folds


def row_keys(*columns: str) -> list[Column]:
    """Columns k1 and k2: two numbers that stand for a row's values in these columns, nulls included."""
    return [F.xxhash64(F.lit(seed), *columns).alias(f"k{seed + 1}") for seed in range(2)]


def fields(df: DataFrame, names: tuple[str, ...]) -> str:
    """The columns as a schema string."""
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)
