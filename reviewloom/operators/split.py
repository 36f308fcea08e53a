"""Time-aware split of every user's reviews into train and test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from reviewloom.schemas import COLD_START_MAX, SPLIT_RATIO


def order_reviews(reviews: DataFrame) -> DataFrame:
    """Add ``position`` (1 = oldest) within the user, and ``n_user``, the user's number of reviews.

    A user may hold a large share of all rows, so no user is ordered in one task. Days are counted
    first, running totals are taken over days, and rows are ordered within one user's day only.
    """
    days = reviews.groupBy("user_id", "review_date").agg(F.count(F.lit(1)).alias("_day"))
    by_user = W.partitionBy("user_id")
    offsets = days.select(
        "user_id",
        "review_date",
        (F.sum("_day").over(by_user.orderBy("review_date")) - F.col("_day")).alias("_before"),
        F.sum("_day").over(by_user).alias("n_user"),
    )
    in_day = F.row_number().over(W.partitionBy("user_id", "review_date").orderBy("review_id"))
    return (
        reviews.withColumn("_in_day", in_day)
        .join(offsets, ["user_id", "review_date"])
        .withColumn("position", F.col("_before") + F.col("_in_day"))
        .drop("_in_day", "_before")
    )


def mark_split(reviews: DataFrame, ratio: float = SPLIT_RATIO) -> DataFrame:
    """Add ``is_test`` and ``n_train``: the oldest ``floor(n * ratio)`` reviews of a user are train."""
    n_train = F.floor(F.col("n_user") * F.lit(float(ratio)))
    ordered = order_reviews(reviews).withColumn("n_train", n_train)
    return ordered.withColumn("is_test", F.col("position") > F.col("n_train"))


def split_train_test(reviews: DataFrame, ratio: float = SPLIT_RATIO) -> tuple[DataFrame, DataFrame]:
    """Train rows, and the test rows whose user and item both occur in train."""
    columns = reviews.columns
    marked = mark_split(reviews, ratio)
    train = marked.where(~F.col("is_test"))
    # a user occurs in train exactly if its own train share is not empty: no join needed
    test = marked.where(F.col("is_test") & (F.col("n_train") > 0))
    test = test.join(train.select("item_id").distinct(), "item_id", "left_semi")
    return train.select(columns), test.select(columns)


def cold_start_users(train: DataFrame, most: int = COLD_START_MAX) -> DataFrame:
    return train.groupBy("user_id").agg(F.count("item_id").alias("n_train")).where(F.col("n_train") <= most)


def cold_start_share(train: DataFrame, most: int = COLD_START_MAX) -> DataFrame:
    sizes = train.groupBy("user_id").agg(F.count("item_id").alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("n_users"),
        F.sum((F.col("n") <= most).cast("bigint")).alias("n_cold"),
        F.round(F.avg((F.col("n") <= most).cast("double")), 6).alias("cold_share"),
    )


def histories(train: DataFrame) -> DataFrame:
    """(user_id, item_id, n): purchase history in long form, repeats counted."""
    return train.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n"))
