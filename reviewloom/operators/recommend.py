"""Train a recommender by name, keep it, and recommend with it; turn its lists into the recommendations table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.operators import als, baseline, content, factorise, neighbours, split
from reviewloom.session import durable
from reviewloom.sources import models

# Names of the recommenders and training parameters of the published runs.
RANDOM, UB_CF, FUNK_SVD = "RANDOM", "UB-CF", "FUNK-SVD"
TI_MF, MOD_ECF, ER_CBF = "TI-MF", "MOD-ECF", "ER-CBF"
ALS = "ALS"  # FUNK-SVD's model, solved by alternating least squares
ALGORITHMS = (RANDOM, UB_CF, FUNK_SVD, TI_MF, MOD_ECF, ER_CBF, ALS)
RUN_EPOCHS, RUN_RATE, RUN_REG = 5, 0.005, 0.1


@dataclass
class Recommender:
    """A trained algorithm: its tables and numbers, which are all that recommending needs."""

    algorithm: str
    tables: dict[str, DataFrame]
    params: dict = field(default_factory=dict)

    def recommend(self, n: int, **settings) -> DataFrame:
        """Lists of unseen items: (user_id, item_rank, item_id, score), ranks from 0."""
        t, p = self.tables, self.params
        if self.algorithm == RANDOM:
            return baseline.drawn_lists(t["seen"], p["mean"], p["sd"], n, p["seed"], **settings)
        if self.algorithm == UB_CF:
            return neighbours.lists_of(t["cells"], t["neighbours"], n)
        if self.algorithm == ER_CBF:
            return content.profile_lists(t["profiles"], t["items"], t["seen"], n, **{"candidates": p["candidates"], **settings})
        return factorise.score_lists(t["users"], t["items"], p["mean"], n, t["seen"], **settings)

    def save(self, spark: SparkSession, path: str) -> int:
        """Store as the next version under ``path``."""
        return models.save(spark, path, self.tables, {"algorithm": self.algorithm, **self.params})

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> Recommender:
        tables, params = models.load(spark, path, version)
        return cls(params.pop("algorithm"), tables, params)


def _needs(vectors: dict, *names: str) -> list[DataFrame]:
    missing = [name for name in names if vectors.get(name) is None]
    if missing:
        raise ValueError(f"this algorithm needs {', '.join(missing)}")
    return [vectors[name] for name in names]


def fit(
    algorithm: str,
    train: DataFrame,
    *,
    user_vectors: DataFrame | None = None,
    item_vectors: DataFrame | None = None,
    **params,
) -> Recommender:
    """Train one algorithm. TI-MF takes topic vectors, MOD-ECF and ER-CBF take review vectors, keyed by user_id and item_id."""
    name = algorithm.upper()
    given = {"user_vectors": user_vectors, "item_vectors": item_vectors}
    seen = train.select("user_id", "item_id").distinct()
    if name == RANDOM:
        moments = baseline.rating_moments(train).first()
        # users, items and pairs are read from it, each of which made the distinct pairs anew
        return Recommender(name, {"seen": train.select("user_id", "item_id")}, {"mean": moments["mean"], "sd": moments["sd"], "seed": 42, **params})
    if name == UB_CF:
        cells, near = neighbours.fit(train, **params)
        return Recommender(name, {"cells": cells, "neighbours": near})
    if name == ER_CBF:
        (items,) = _needs(given, "item_vectors")
        bought = durable(split.histories(train))  # for the profiles and the pairs to leave out
        tables = {"profiles": content.history_profiles(bought, items), "items": items, "seen": bought.select("user_id", "item_id")}
        return Recommender(name, tables, {"candidates": content.CANDIDATES, **params})
    if name == ALS:
        model = als.fit(train, **params)
    elif name in (FUNK_SVD, TI_MF, MOD_ECF):
        settings = {"epochs": RUN_EPOCHS, "rate": RUN_RATE, "reg": RUN_REG, **params}
        if name == FUNK_SVD:
            factors, seed = settings.pop("factors", factorise.FACTORS), settings.pop("seed", 42)
            starts = [factorise.random_start(train, key, factors, seed + i) for i, key in enumerate(("user_id", "item_id"))]
        else:
            starts = _needs(given, "user_vectors", "item_vectors")
        model = factorise.fit(train, *starts, **settings)
    else:
        raise ValueError(f"unknown algorithm {algorithm!r}; known are {', '.join(ALGORITHMS)}")
    return Recommender(name, {"users": model.users, "items": model.items, "seen": seen}, {"mean": model.mean})


def recommend(
    algorithm: str,
    train: DataFrame,
    n: int,
    *,
    user_vectors: DataFrame | None = None,
    item_vectors: DataFrame | None = None,
    grid: tuple[int, int] | None = None,
    **params,
) -> DataFrame:
    """Lists of one algorithm, trained on the way: (user_id, item_rank, item_id, score), ranks from 0."""
    trained = fit(algorithm, train, user_vectors=user_vectors, item_vectors=item_vectors, **params)
    return trained.recommend(n, **({"blocks": grid} if grid else {}))


def one_title(train: DataFrame, order: str = "review_id") -> DataFrame:
    """(item_id, title): the title of an item's first review."""
    return train.groupBy("item_id").agg(F.min_by("title", order).alias("title"))


def recommendations_table(lists: DataFrame, titles: DataFrame, algorithm: str) -> DataFrame:
    """(user_id, item_rank, item_id, algorithm, title). An item with two titles gives two rows."""
    names = titles.select("item_id", "title").distinct()
    return (
        lists.select("user_id", F.col("item_rank").cast("int").alias("item_rank"), "item_id")
        .withColumn("algorithm", F.lit(algorithm.upper()))
        .join(names, "item_id", "left")
        .select("user_id", "item_rank", "item_id", "algorithm", "title")
    )


def user_report(train: DataFrame, lists: DataFrame, user: object) -> tuple[DataFrame, DataFrame]:
    """Purchase history and recommended items of one user, both with titles, the latter in rank order."""
    history = train.where(F.col("user_id") == F.lit(user)).select("item_id", "title")
    chosen = lists.where(F.col("user_id") == F.lit(user)).select("item_rank", "item_id")
    # titles of the few chosen items only
    titles = one_title(train.join(chosen.select("item_id"), "item_id", "left_semi"))
    return history, chosen.join(titles, "item_id").orderBy("item_rank").select("item_id", "title")
