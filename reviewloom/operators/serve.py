"""Lookups on the stored recommendations table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.operators.explore import sample_users
from reviewloom.sources import lookup

USER, RANK, ALGORITHM = "user_id", "item_rank", "algorithm"


def store_recommendations(recommendations: DataFrame, name: str, path: str | None = None, buckets: int | None = None) -> DataFrame:
    """Store (user_id, item_rank, item_id, algorithm, title); storing an algorithm again replaces its lists."""
    return lookup.store(recommendations, name, USER, (RANK, "item_id", "title"), (ALGORITHM,), path=path, buckets=buckets)


def store_history(train: DataFrame, name: str, path: str | None = None, buckets: int | None = None) -> DataFrame:
    """Store every user's reviews (user_id, item_id, title) for lookups by user."""
    return lookup.store(train.select(USER, "item_id", "title"), name, USER, ("item_id", "title"), path=path, buckets=buckets)


def list_users(recommendations: DataFrame) -> DataFrame:
    """Distinct users; on a stored table without a shuffle, as its buckets hold whole users."""
    return recommendations.select(USER).distinct()


def history(spark: SparkSession, table: str, user: object) -> DataFrame:
    """(item_id, title) of one user's reviews, from a stored table."""
    return lookup.find(spark, table, user_id=user).select("item_id", "title")


def top_n(spark: SparkSession, table: str, user: object, algorithm: str, n: int) -> DataFrame:
    """First n items of one user and algorithm, from a stored table."""
    return lookup.find(spark, table, (RANK,), n, user_id=user, algorithm=algorithm.upper())


def demo_extract(recommendations: DataFrame, n_users: int = 100, seed: int = 42, pinned: tuple = ()) -> DataFrame:
    """All recommendations of a repeatable sample of users and of the pinned users."""
    users = sample_users(recommendations, n_users, seed, pinned)
    return recommendations.join(users, USER, "left_semi")


def metrics_of(metrics: DataFrame, category: str) -> DataFrame:
    return metrics.where(F.col("Category") == category)
