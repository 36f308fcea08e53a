"""Biased matrix factorisation by stochastic gradient descent, from given or random start vectors.

Users and items are hashed into d blocks each. An epoch has d steps; in step s, task b holds user block
b, item block (b + s) mod d and the ratings between them, so that no two tasks of a step share a user
or an item (stratified SGD, Gemulla et al., KDD 2011). A busy user or a popular item is thereby cut
into d parts. With d = 1 this is the plain sequential rule.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom.functions.scalar import seeded_normal
from reviewloom.operators.cells import by_cell
from reviewloom.operators.grid import dot_scorer, grid_top_k
from reviewloom.schemas import RATING_MAX, RATING_MIN
from reviewloom.session import discard, durable

# Defaults of the model.
FACTORS, EPOCHS, LEARNING_RATE, REGULARISATION, RANDOM_SD = 50, 10, 0.005, 0.02, 0.1
RATINGS_PER_CELL = 1_000_000
LEAST_BLOCKS = 4  # whatever the cluster, so that results do not depend on it


def random_start(ids: DataFrame, key: str, factors: int = FACTORS, seed: int = 42, sd: float = RANDOM_SD) -> DataFrame:
    """(key, vec): normal draws that depend on the id alone, not on partitioning."""
    draw = F.transform(F.sequence(F.lit(1), F.lit(factors)), lambda j: seeded_normal(F.col(key), j, seed, sd))
    return ids.select(key).distinct().withColumn("vec", draw)


def turns(users: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Turn of each rating: one more than the last turn of its user and of its item.

    Ratings of one turn share nothing, and each rating comes after all earlier ones it depends on, so
    taking turn by turn gives exactly the result of the given order.
    """
    last_user = [0] * (int(users.max()) + 1 if len(users) else 0)
    last_item = [0] * (int(items.max()) + 1 if len(items) else 0)
    out = np.empty(len(users), dtype=np.int64)
    for at, (u, i) in enumerate(zip(users.tolist(), items.tolist())):
        turn = max(last_user[u], last_item[i]) + 1
        last_user[u] = last_item[i] = turn
        out[at] = turn
    return out


def _with_turns(cell: pa.Table) -> pa.Table:
    """The ratings of one task and step with their turns, in order of these. They are the same in all epochs."""
    cell = cell.combine_chunks().sort_by([("user_id", "ascending"), ("place", "ascending")])
    users, items = (cell[c].combine_chunks().dictionary_encode().indices.to_numpy() for c in ("user_id", "item_id"))
    return cell.drop_columns(["place"]).append_column("turn", pa.array(turns(users, items))).sort_by("turn")


def descend(p, q, bias_u, bias_i, users, items, ratings, turn, mean: float, rate: float, reg: float) -> None:
    """One pass over the ratings, turn by turn, in place."""
    bounds = np.flatnonzero(np.diff(turn)) + 1
    for a, b in zip([0, *bounds.tolist()], [*bounds.tolist(), len(users)]):
        u, i = users[a:b], items[a:b]
        pu, qi = p[u], q[i]
        err = ratings[a:b] - (mean + bias_u[u] + bias_i[i] + np.einsum("ij,ij->i", pu, qi))
        bias_u[u] += rate * (err - reg * bias_u[u])
        bias_i[i] += rate * (err - reg * bias_i[i])
        p[u] = pu + rate * (err[:, None] * qi - reg * pu)
        q[i] = qi + rate * (err[:, None] * pu - reg * qi)


def _as_lists(vectors: np.ndarray) -> pa.Array:
    offsets = np.arange(0, vectors.size + 1, vectors.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, vectors.ravel())


def _train_cell(mean: float, rate: float, reg: float, factors: int):
    def train(cell: pa.Table) -> pa.Table:
        kind = cell["kind"].to_numpy()
        users = cell.filter(pa.array(kind == 0))
        items = cell.filter(pa.array(kind == 1))
        rated = cell.filter(pa.array(kind == 2)).sort_by("turn")

        def start(side: pa.Table):
            vecs = side["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            return np.array(vecs).reshape(-1, factors), np.array(side["bias"].to_numpy())

        p, bias_u = start(users)
        q, bias_i = start(items)
        if len(rated):
            u = pa.compute.index_in(rated["user_id"].combine_chunks(), users["user_id"].combine_chunks())
            i = pa.compute.index_in(rated["item_id"].combine_chunks(), items["item_id"].combine_chunks())
            descend(
                p, q, bias_u, bias_i, u.to_numpy().astype(np.int64), i.to_numpy().astype(np.int64),
                rated["rating"].to_numpy(), rated["turn"].to_numpy(), mean, rate, reg,
            )
        return pa.table(
            {
                "user_id": pa.concat_arrays([users["user_id"].combine_chunks(), items["user_id"].combine_chunks()]),
                "item_id": pa.concat_arrays([users["item_id"].combine_chunks(), items["item_id"].combine_chunks()]),
                "bias": np.concatenate([bias_u, bias_i]),
                "vec": _as_lists(np.concatenate([p, q])),
            }
        )

    return train


class Factorisation:
    """Trained factors: ``users`` (user_id, bias, vec), ``items`` (item_id, bias, vec), global ``mean``."""

    def __init__(self, users: DataFrame, items: DataFrame, mean: float):
        self.users, self.items, self.mean = users, items, mean

    def recommend(self, n: int, seen: DataFrame, blocks: tuple[int, int] | None = None) -> DataFrame:
        """The n unseen items with the highest clipped rating; ties go to the lower item id."""
        return score_lists(self.users, self.items, self.mean, n, seen, blocks)

    def estimate(self, pairs: DataFrame, clip: bool = True) -> DataFrame:
        """Ratings of given pairs. Terms of an unknown user or item are left out."""
        return estimate_pairs(self.users, self.items, self.mean, pairs, clip)


def score_lists(
    users: DataFrame, items: DataFrame, mean: float, n: int, seen: DataFrame, blocks: tuple[int, int] | None = None
) -> DataFrame:
    # the biases become two more components: (p, bu, 1) . (q, 1, bi)
    one = F.lit(1.0)
    return grid_top_k(
        users.select("user_id", F.concat("vec", F.array("bias", one)).alias("vec")),
        items.select("item_id", F.concat("vec", F.array(one, "bias")).alias("vec")),
        n,
        dot_scorer(mean, (RATING_MIN, RATING_MAX)),
        seen=seen,
        blocks=blocks,
        ceiling=RATING_MAX,
    )


def estimate_pairs(users: DataFrame, items: DataFrame, mean: float, pairs: DataFrame, clip: bool = True) -> DataFrame:
    from reviewloom.functions.scalar import clip_rating, dot, rounded

    u = users.select("user_id", F.col("bias").alias("_bu"), F.col("vec").alias("_p"))
    i = items.select("item_id", F.col("bias").alias("_bi"), F.col("vec").alias("_q"))
    zero = F.lit(0.0)
    est = (
        F.lit(mean) + F.coalesce("_bu", zero) + F.coalesce("_bi", zero) + F.coalesce(dot(F.col("_p"), F.col("_q")), zero)
    )
    joined = pairs.join(u, "user_id", "left").join(i, "item_id", "left")
    return joined.select("user_id", "item_id", rounded(clip_rating(est) if clip else est).alias("score"))


def fit(
    train: DataFrame,
    user_start: DataFrame,
    item_start: DataFrame,
    epochs: int = EPOCHS,
    rate: float = LEARNING_RATE,
    reg: float = REGULARISATION,
    blocks: int | None = None,
    order: str = "review_id",
) -> Factorisation:
    """Train from ``user_start`` (user_id, vec) and ``item_start`` (item_id, vec).

    The result depends on ``blocks`` as it fixes the order of the updates; by default it follows from the number of
    ratings. It does not depend on partitioning or on the cluster. The start tables are not changed.
    """
    head = train.agg(F.avg("rating").alias("mean"), F.count(F.lit(1)).alias("n")).first()
    mean = head["mean"]
    if blocks is None:
        blocks = max(LEAST_BLOCKS, math.ceil(math.sqrt(head["n"] / RATINGS_PER_CELL)))
    user_type, item_type = train.schema["user_id"].dataType, train.schema["item_id"].dataType
    user_block = F.pmod(F.xxhash64("user_id"), F.lit(blocks)).cast("int")
    item_block = F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")
    no_user, no_item = F.lit(None).cast(user_type), F.lit(None).cast(item_type)
    null = F.lit(None)
    vec = F.col("vec").cast("array<double>").alias("vec")
    # start vectors of ids that train does not hold would never be used again
    starts = user_start.join(train.select("user_id").distinct(), "user_id", "left_semi").select(
        "user_id", no_item.alias("item_id"), F.lit(0.0).alias("bias"), vec
    ).unionByName(
        item_start.join(train.select("item_id").distinct(), "item_id", "left_semi").select(
            no_user.alias("user_id"), "item_id", F.lit(0.0).alias("bias"), vec
        )
    )
    state = durable(starts)
    first = state.select(F.size("vec").alias("n")).first()
    if first is None:
        raise ValueError("no start vectors for the users and items of train")
    factors = first["n"]
    # one folder per step, so that each step reads its own ratings only
    placed = train.select(
        user_block.alias("cell"), F.pmod(item_block - user_block, F.lit(blocks)).alias("step"),
        "user_id", "item_id", F.col("rating").cast("double").alias("rating"), F.col(order).alias("place"),
    )
    kept = T.StructType([f for f in placed.schema.fields if f.name != "place"] + [T.StructField("turn", T.LongType())])
    ratings = durable(placed.groupBy("step", "cell").applyInArrow(_with_turns, kept), "step")
    schema = T.StructType(
        [
            T.StructField("user_id", user_type),
            T.StructField("item_id", item_type),
            T.StructField("bias", T.DoubleType()),
            T.StructField("vec", T.ArrayType(T.DoubleType())),
        ]
    )
    is_user = F.col("item_id").isNull()
    before = state
    for _ in range(epochs):
        for step in range(blocks):
            held = state.select(
                F.when(is_user, 0).otherwise(1).alias("kind"),
                F.when(is_user, user_block).otherwise(F.pmod(item_block - F.lit(step), F.lit(blocks))).alias("cell"),
                "user_id", "item_id", "bias", "vec",
                null.cast("double").alias("rating"), null.cast("bigint").alias("turn"),
            )
            stratum = ratings.where(F.col("step") == step).select(
                F.lit(2).alias("kind"), "cell", "user_id", "item_id",
                null.cast("double").alias("bias"), null.cast("array<double>").alias("vec"), "rating", "turn",
            )
            state = (
                by_cell(held.unionByName(stratum), blocks)
                .groupBy("cell")
                .applyInArrow(_train_cell(mean, rate, reg, factors), schema)
            )
        written = durable(state)
        discard(before)
        state = before = written
    discard(ratings)
    return Factorisation(
        state.where(is_user).select("user_id", "bias", "vec"),
        state.where(~is_user).select("item_id", "bias", "vec"),
        mean,
    )

