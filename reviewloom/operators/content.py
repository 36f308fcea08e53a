"""Content filter over item vectors: nearest items to the mean vector of a user's purchases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.scalar import unit
from reviewloom.operators.grid import dot_scorer, grid_top_k, rank_items
from reviewloom.operators.split import histories
from reviewloom.session import durable

CANDIDATES = 200  # fixed value: items looked at per user before rated ones are dropped


def mean_of_arrays(df: DataFrame, keys: Sequence[str], weight: str, dim: int) -> DataFrame:
    """(keys, vec): weighted mean of the ``vec`` arrays, one plain sum per place.

    Sums of doubles are combined before the shuffle and kept in fixed-width rows that can spill.
    """
    total = F.sum(weight)
    return df.groupBy(*keys).agg(
        F.array(*[F.sum(F.get("vec", F.lit(j)) * F.col(weight)) / total for j in range(dim)]).alias("vec")
    )


def user_profiles(train: DataFrame, item_vectors: DataFrame) -> DataFrame:
    """(user_id, vec): mean of the vectors of the bought items, each purchase counted."""
    return history_profiles(histories(train), item_vectors)


def history_profiles(bought: DataFrame, item_vectors: DataFrame) -> DataFrame:
    """``user_profiles`` from histories (user_id, item_id, n)."""
    head = item_vectors.select(F.size("vec").alias("dim")).first()
    if head is None:
        raise ValueError("no item vectors")
    return mean_of_arrays(bought.join(item_vectors, "item_id"), ["user_id"], "n", head["dim"])


def nearest_items(
    queries: DataFrame, item_vectors: DataFrame, k: int = CANDIDATES, blocks: tuple[int, int] | None = None,
    marked: DataFrame | None = None, seen: DataFrame | None = None,
) -> DataFrame:
    """The k items with the highest cosine to each query vector (user_id, vec), without the ``seen`` pairs, if given, and which
    are among the ``marked`` pairs, if given."""
    return grid_top_k(
        queries.withColumn("vec", unit(F.col("vec"))),
        item_vectors.withColumn("vec", unit(F.col("vec"))),
        k,
        dot_scorer(),
        seen=seen,
        blocks=blocks,
        marked=marked,
    )


def embedded_review_lists(
    train: DataFrame,
    item_vectors: DataFrame,
    n: int,
    candidates: int = CANDIDATES,
    blocks: tuple[int, int] | None = None,
) -> DataFrame:
    """(user_id, item_rank, item_id, score). Candidates are cut before rated items are dropped."""
    bought = durable(histories(train))
    seen = bought.select("user_id", "item_id")
    return profile_lists(history_profiles(bought, item_vectors), item_vectors, seen, n, candidates, blocks)


def profile_lists(
    profiles: DataFrame,
    item_vectors: DataFrame,
    seen: DataFrame,
    n: int,
    candidates: int = CANDIDATES,
    blocks: tuple[int, int] | None = None,
) -> DataFrame:
    """Lists from user profiles (user_id, vec) and the distinct pairs (user_id, item_id) to leave out.

    A user's n best unseen items are among the first n + (rated items), so the cut after ``candidates`` only matters to users
    with many rated items. The others keep n items instead of all candidates, unless items come more than once.
    """
    seen = seen.dropna()

    def best(users: DataFrame, k: int, **pairs: DataFrame) -> DataFrame:
        return nearest_items(users, item_vectors, k, blocks, **pairs)

    copies = item_vectors.groupBy("item_id").count().agg(F.max("count")).first()[0] or 1
    if copies > 1:  # a rated item can take several places
        return rank_items(best(profiles, candidates, marked=seen).where(~F.col("marked")), n)
    many = durable(seen.groupBy("user_id").count().where(F.col("count") > candidates - n).select("user_id"))
    if many.isEmpty():
        return best(profiles, min(n, candidates), seen=seen)
    profiles = durable(profiles)
    near = best(profiles.join(many, "user_id", "left_semi"), candidates, marked=seen.join(many, "user_id", "left_semi"))
    few = best(profiles.join(many, "user_id", "left_anti"), min(n, candidates), seen=seen.join(many, "user_id", "left_anti"))
    return few.unionByName(rank_items(near.where(~F.col("marked")), n))
