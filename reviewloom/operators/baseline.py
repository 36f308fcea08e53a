"""Random lists: one normal draw per unseen pair, from a hash of the pair."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.scalar import HASH_ITEM, HASH_MIX, HASH_PRIME, HASH_USER, hash_code
from reviewloom.operators.grid import grid_top_k
from reviewloom.schemas import RATING_MAX, RATING_MIN


def rating_moments(train: DataFrame, rating: str = "rating") -> DataFrame:
    return train.agg(F.avg(rating).alias("mean"), F.stddev_pop(rating).alias("sd"))


def pair_draws(user_codes: np.ndarray, item_codes: np.ndarray, mean: float, sd: float, seed: int) -> np.ndarray:
    """Clipped normal draws for all pairs of codes; the same whatever block a pair falls into."""
    u, i = user_codes.astype(np.int64), item_codes.astype(np.int64)
    mixed = ((u * HASH_USER) % HASH_PRIME + (i * HASH_ITEM) % HASH_PRIME + seed) % HASH_PRIME
    first = ((mixed * mixed) % HASH_PRIME * HASH_MIX + i) % HASH_PRIME
    second = ((first * first) % HASH_PRIME * HASH_USER + u) % HASH_PRIME
    scale = float(HASH_PRIME + 1)
    normal = np.sqrt(-2.0 * np.log((first + 1) / scale)) * np.cos(2.0 * np.pi * ((second + 1) / scale))
    return np.clip(mean + sd * normal, RATING_MIN, RATING_MAX)


def _codes(df: DataFrame, key: str) -> DataFrame:
    code = hash_code(F.col(key), dict(df.dtypes)[key])
    return df.select(key, F.array(code.cast("double")).alias("vec"))


def random_lists(train: DataFrame, n: int, seed: int = 42, blocks: tuple[int, int] | None = None) -> DataFrame:
    moments = rating_moments(train).first()
    pairs = train.select("user_id", "item_id")
    return drawn_lists(pairs, moments["mean"], moments["sd"], n, seed, blocks)


def drawn_lists(
    pairs: DataFrame, mean: float, sd: float, n: int, seed: int = 42, blocks: tuple[int, int] | None = None
) -> DataFrame:
    """Lists from the moments of the ratings and the pairs (user_id, item_id) that were rated; a pair may come twice."""

    def scorer(users: np.ndarray, items: np.ndarray) -> np.ndarray:
        return pair_draws(users, items.T, mean, sd, seed)

    return grid_top_k(
        _codes(pairs.select("user_id").distinct(), "user_id"),
        _codes(pairs.select("item_id").distinct(), "item_id"),
        n,
        scorer,
        seen=pairs,
        blocks=blocks,
        ceiling=RATING_MAX,
    )
