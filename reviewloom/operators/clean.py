"""Join of reviews with item metadata, row filters, and overviews of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.scalar import empty_to_null

TITLE_MARKUP = "getTime"  # fixed value: script fragment that marks a broken title


def drop_markup_titles(meta: DataFrame, title: str = "title") -> DataFrame:
    """Drop items whose title is page script; items without a title stay for now."""
    return meta.where(~F.coalesce(F.col(title).contains(TITLE_MARKUP), F.lit(False)))


def blank_to_null(df: DataFrame) -> DataFrame:
    """Turn exactly empty strings into nulls in all string columns."""
    strings = {name for name, kind in df.dtypes if kind == "string"}
    return df.select(*[empty_to_null(F.col(c)).alias(c) if c in strings else F.col(c) for c in df.columns])


def merge_reviews(
    reviews: DataFrame,
    meta: DataFrame,
    key: str = "item_id",
    required: Sequence[str] | None = None,
    dedupe_meta: bool = False,
) -> DataFrame:
    """Inner join of metadata and reviews, without rows that lack a required value.

    An item listed twice in the metadata doubles its reviews, unless ``dedupe_meta``.
    """
    meta = drop_markup_titles(meta)
    if dedupe_meta:
        rest = [c for c in meta.columns if c != key]
        first = F.min_by(F.struct(*rest), F.struct(*[F.col(c).cast("string") for c in rest]))
        meta = meta.groupBy(key).agg(first.alias("_m")).select(key, "_m.*")
    merged = blank_to_null(meta.join(reviews, key))
    return merged.dropna(subset=list(required) if required else merged.columns)


def drop_empty_texts(df: DataFrame, text: str = "processed_text") -> DataFrame:
    return df.where(F.col(text).isNotNull() & (F.col(text) != ""))


def sparsity(df: DataFrame, rating: str = "rating", text: str = "review_text") -> DataFrame:
    """Share of empty cells in the user x item matrix, in percent, for ratings and for texts."""
    cells = F.countDistinct("user_id") * F.countDistinct("item_id")
    return df.agg(
        F.round((1 - F.count(rating) / cells) * 100, 6).alias("rating_sparsity"),
        F.round((1 - F.count(text) / cells) * 100, 6).alias("review_sparsity"),
    )


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def overview(df: DataFrame) -> DataFrame:
    """One row per column: name, type, non-null values. All counts come from one pass."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"), F.lit(t).alias("column_type"), F.col(f"`{c}`").alias("non_null")
            )
            for c, t in df.dtypes
        ]
    )
    return counts.select(F.inline(entries))
