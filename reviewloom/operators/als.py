"""Biased matrix factorisation by alternating least squares.

With items fixed, each user's bias and vector are the solution of a small ridge problem over its ratings, and the other way
round. Users and items are dealt into blocks once. A half step sends each block the factors that its ratings name, once
per block, and solves all of its rows there; factors of the side that is solved for move nowhere. A row with very many ratings
is cut into parts: each part adds up its share of the normal equations, and the shares are summed and solved. Ridge
problems are solved exactly, so the result does not depend on partitioning but for rounding.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom.operators.cells import MOST_PARTITIONS
from reviewloom.operators.factorise import FACTORS, Factorisation, random_start
from reviewloom.session import discard, durable

EPOCHS, REGULARISATION = 10, 2.0
RATINGS_PER_BLOCK = 200_000
MOST_RATINGS = 50_000  # of one row that are handled in one part
LEAST_BLOCKS = 8  # whatever the cluster


def normal_equations(features: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gram matrix and right side of a least squares problem; the last feature is the constant of the bias."""
    wide = np.concatenate([features, np.ones((len(features), 1))], axis=1)
    return wide.T @ wide, wide.T @ target


def solved(gram: np.ndarray, right: np.ndarray, reg: float) -> np.ndarray:
    """Vector, then bias, of the ridge problem; reg holds for both."""
    return np.linalg.solve(gram + reg * np.eye(len(gram)), right)


def _solve_block(key: str, other: str, mean: float, reg: float, factors: int):
    """Rows of one block: ratings (key, part, parts, other, rating) with the factors they name (other, bias, vec)."""

    def run(rated: pa.Table, named: pa.Table) -> pa.Table:
        rated, named = rated.combine_chunks(), named.combine_chunks()
        out_key, out_gram, out_right, out_vec, out_bias = [], [], [], [], []
        if len(rated):
            at = pa.compute.index_in(rated[other].combine_chunks(), named[other].combine_chunks()).to_numpy()
            features = named["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, factors)
            target = rated["rating"].to_numpy() - mean - named["bias"].to_numpy()[at]
            codes = rated[key].combine_chunks().dictionary_encode()
            rows = codes.indices.to_numpy()
            group = rows.astype(np.int64) * (1 << 20) + rated["part"].to_numpy()
            order = np.argsort(group, kind="stable")
            bounds = np.flatnonzero(np.append(True, np.diff(group[order]) != 0))
            parts = rated["parts"].to_numpy()
            for a, b in zip(bounds, np.append(bounds[1:], len(order)), strict=True):
                own = order[a:b]
                gram, right = normal_equations(features[at[own]], target[own])
                out_key.append(rows[own[0]])
                if parts[own[0]] > 1:
                    out_gram.append(gram.reshape(-1))
                    out_right.append(right)
                    out_vec.append(None)
                    out_bias.append(None)
                else:
                    answer = solved(gram, right, reg)
                    out_gram.append(None)
                    out_right.append(None)
                    out_vec.append(answer[:-1])
                    out_bias.append(answer[-1])
            ids = codes.dictionary.take(pa.array(out_key))
        else:
            ids = rated[key].combine_chunks().slice(0, 0)
        doubles = pa.list_(pa.float64())
        return pa.table({
            key: ids, "bias": pa.array(out_bias, pa.float64()), "vec": pa.array(out_vec, doubles),
            "gram": pa.array(out_gram, doubles), "right": pa.array(out_right, doubles),
        })

    return run


def _sum_parts(key: str, reg: float):
    def run(shares: pa.Table) -> pa.Table:
        shares = shares.combine_chunks()
        right = np.array(shares["right"].to_pylist()).sum(axis=0)
        gram = np.array(shares["gram"].to_pylist()).sum(axis=0).reshape(len(right), -1)
        answer = solved(gram, right, reg)
        return pa.table({key: shares[key].slice(0, 1), "bias": [float(answer[-1])], "vec": [answer[:-1].tolist()]})

    return run


def _dealt(ratings: DataFrame, key: str, other: str, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Ratings by block of ``key``, large rows cut into parts that lie in blocks of their own; and which factors go to which block."""
    sizes = ratings.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / MOST_RATINGS).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64(other), F.col("parts")).cast("int")
    cut = ratings.join(sizes, key).withColumn("part", part)
    block = F.pmod(F.xxhash64(key, F.when(F.col("parts") > 1, F.col("part")).otherwise(0)), F.lit(blocks)).cast("int")
    dealt = durable(cut.select(block.alias("block"), key, "part", "parts", other, "rating").repartition(min(blocks, MOST_PARTITIONS), "block"))
    return dealt, durable(dealt.select("block", other).distinct())


def _half_step(
    dealt: DataFrame, routes: DataFrame, factors_of_other: DataFrame, key: str, other: str, mean: float, reg: float, factors: int, cut: bool
) -> DataFrame:
    """Factors of ``key``. If no row is ``cut`` into parts, what the blocks hand on is written once and final."""
    kind = dealt.schema[key].dataType
    doubles = T.ArrayType(T.DoubleType())
    row = [T.StructField(key, kind), T.StructField("bias", T.DoubleType()), T.StructField("vec", doubles)]
    shares = [T.StructField("gram", doubles), T.StructField("right", doubles)]
    named = routes.join(factors_of_other, other)
    found = (
        dealt.groupBy("block").cogroup(named.groupBy("block"))
        .applyInArrow(_solve_block(key, other, mean, reg, factors), T.StructType([*row, *shares]))
    )
    if not cut:
        return durable(found.select(key, "bias", "vec"))
    found = durable(found)
    whole = found.where("vec is not null").select(key, "bias", "vec")
    split = found.where("vec is null").select(key, "gram", "right")
    solved_rows = durable(whole.unionByName(split.groupBy(key).applyInArrow(_sum_parts(key, reg), T.StructType(row))))
    discard(found)
    return solved_rows


def fit(
    train: DataFrame, factors: int = FACTORS, epochs: int = EPOCHS, reg: float = REGULARISATION, seed: int = 42,
    blocks: int | None = None, item_start: DataFrame | None = None,
) -> Factorisation:
    """Factors of ``train`` (user_id, item_id, rating) from start vectors of the items (item_id, vec), by default random ones.

    Every rating counts; a pair rated twice counts twice. Rows without user, item or rating take no part.
    """
    ratings = durable(train.select("user_id", "item_id", F.col("rating").cast("double").alias("rating")).dropna())
    head = ratings.agg(F.avg("rating").alias("mean"), F.count(F.lit(1)).alias("n")).first()
    if not head["n"]:
        raise ValueError("no ratings")
    blocks = blocks or max(LEAST_BLOCKS, math.ceil(head["n"] / RATINGS_PER_BLOCK))
    start = item_start if item_start is not None else random_start(ratings, "item_id", factors, seed)
    items = durable(
        start.join(ratings.select("item_id").distinct(), "item_id", "left_semi")
        .select("item_id", F.lit(0.0).alias("bias"), F.col("vec").cast("array<double>").alias("vec"))
    )
    first = items.select(F.size("vec").alias("n")).first()
    if first is None:
        raise ValueError("no start vectors for the items of train")
    by_user, item_routes = _dealt(ratings, "user_id", "item_id", blocks)
    by_item, user_routes = _dealt(ratings, "item_id", "user_id", blocks)
    cut_users, cut_items = (dealt.agg(F.max("parts")).first()[0] > 1 for dealt in (by_user, by_item))
    users = None
    for _ in range(epochs):
        before = [users, items] if users is not None else [items]
        users = _half_step(by_user, item_routes, items, "user_id", "item_id", head["mean"], reg, first["n"], cut_users)
        items = _half_step(by_item, user_routes, users, "item_id", "user_id", head["mean"], reg, first["n"], cut_items)
        discard(*before)  # only the last factors are read again
    discard(ratings, by_user, by_item, item_routes, user_routes)
    return Factorisation(users, items, head["mean"])
