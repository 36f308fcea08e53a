"""Recall, precision and novelty of ranked lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.schemas import LIST_LENGTHS


def item_popularity(train: DataFrame, counted: str = "review_id") -> DataFrame:
    """Reviews of an item as a share of the reviews of the most reviewed item."""
    counts = train.groupBy("item_id").agg(F.count(counted).alias("n_reviews"))
    most = counts.agg(F.max("n_reviews").alias("m")).scalar()
    return counts.select("item_id", "n_reviews", (F.col("n_reviews") / most).alias("popularity"))


def per_user_metrics(
    recs: DataFrame, test: DataFrame, popularity: DataFrame, lengths: Sequence[int] = LIST_LENGTHS
) -> DataFrame:
    """(user_id, n, hits, recall, precision, novelty) for users with both test rows and a list.

    ``recs`` is (user_id, item_rank, item_id, ...). All list lengths come from one pass: each
    recommended item adds to every length beyond its rank. Recall divides by the number of test rows,
    repeats included; novelty divides by n even if the list is shorter.
    """
    actual = test.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("_rows"))
    actual_size = actual.groupBy("user_id").agg(F.sum("_rows").alias("_actual"))
    judged = (
        recs.select("user_id", "item_rank", "item_id")
        .join(popularity.select("item_id", "popularity"), "item_id", "left")
        .join(actual.withColumn("_hit", F.lit(1)), ["user_id", "item_id"], "left")
    )
    sums = []
    for n in lengths:
        inside = F.col("item_rank") < n
        # distinct items: a list may name an item once only, so a plain sum counts sets
        sums.append(F.sum(F.when(inside, F.coalesce("_hit", F.lit(0))).otherwise(0)).alias(f"_h{n}"))
        sums.append(F.sum(F.when(inside, F.coalesce("popularity", F.lit(0.0))).otherwise(0.0)).alias(f"_p{n}"))
    per_user = judged.groupBy("user_id").agg(*sums).join(actual_size, "user_id")
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("n"),
                F.col(f"_h{n}").alias("hits"),
                (F.col(f"_h{n}") / F.col("_actual")).alias("recall"),
                (F.col(f"_h{n}") / F.lit(n)).alias("precision"),
                ((F.lit(n) - F.col(f"_p{n}")) / F.lit(n)).alias("novelty"),
            )
            for n in lengths
        ]
    )
    return per_user.select("user_id", F.inline(rows))


def evaluate(
    recs: DataFrame,
    test: DataFrame,
    popularity: DataFrame,
    lengths: Sequence[int] = LIST_LENGTHS,
    users: DataFrame | None = None,
) -> DataFrame:
    """Means over users per list length. ``users`` restricts the lists, e.g. to cold-start users."""
    if users is not None:
        recs = recs.join(users.select("user_id"), "user_id", "left_semi")
    return (
        per_user_metrics(recs, test, popularity, lengths)
        .groupBy("n")
        .agg(
            F.count(F.lit(1)).alias("n_users"),
            F.round(F.avg("recall"), 6).alias("recall"),
            F.round(F.avg("precision"), 6).alias("precision"),
            F.round(F.avg("novelty"), 6).alias("novelty"),
        )
    )


def users_with_hits(per_user: DataFrame) -> DataFrame:
    return per_user.where(F.col("recall") > 0)


def metric_pivot(metrics: DataFrame, metric: str, algorithms: Sequence[str]) -> DataFrame:
    """One column per algorithm, one row per category and list length."""
    return metrics.groupBy("category", "n").pivot("algorithm", list(algorithms)).agg(F.first(metric))
