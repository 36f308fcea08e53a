"""User-based collaborative filtering on centred ratings with filled gaps.

The user x item matrix of deviations from the user's mean is filled with item means, so every pair of
users has a similarity. It is never built: with m the item means, e the difference of a deviation from
its item's mean (rated cells only), M = sum m^2 and a = sum m e per user,

    dot(u, v) = M + a_u + a_v + sum over common items of e_u e_v
    norm(u)^2 = M + 2 a_u + sum e_u^2

so that a user is two numbers and its own rated cells.

With h = M / 2 + a, q = 1 / norm and p = h q a similarity is q_u (h_u q_v + p_v) + q_u q_v (sum over common items): a part
that needs no items, and a sparse one. Users are put in order of the first part, for a user in the middle, and cut into
blocks. Every block meets itself and the first blocks, which gives each user a k-th best similarity to beat. The largest
h q_v + p_v of a block is a convex function of h, so its values at some places bound it between them, and a user only
meets the blocks that can beat its k-th best. Others may hold users with common items who still do so: inverted lists
hold, per item and block, the largest and smallest e q, and only where these can lift a user over its k-th best are that
user's common items looked up. What is left out is below the k-th best for certain, so lists are those of all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from reviewloom.functions.scalar import rounded
from reviewloom.operators.cells import by_cell
from reviewloom.operators.grid import best_per_row, id_ranks
from reviewloom.operators.numbering import numbered
from reviewloom.session import durable

NEIGHBOURS = 50  # fixed value
USER_BLOCK = 2048  # users per side of one cell: 32 MB of similarities
PAIRS_AT_ONCE = 4_000_000
DENSE_PAIRS = 65_536  # items with more pairs in a cell go through a matrix product
PLACES = 16  # intervals of h between which a block's largest similarity is bounded
FIRST_BLOCKS = 1  # blocks of the users most similar to all others, which everyone meets
SLACK = 2e-6  # more than rounding to six digits can move a similarity


def deviations(train: DataFrame) -> DataFrame:
    """(user_id, item_id, n, user_mean, item_dev, e): rated cells, repeats averaged.

    Ratings are summed per pair before anything is shuffled by user or by item alone, so a popular item
    has at most one row per user there, and a busy user one row per item.
    """
    cells = train.groupBy("user_id", "item_id").agg(
        F.sum("rating").alias("_sum"), F.count("rating").alias("_rated"), F.count(F.lit(1)).alias("n")
    )
    users = cells.groupBy("user_id").agg((F.sum("_sum") / F.sum("_rated")).alias("user_mean"))
    centred = cells.join(users, "user_id").select(
        "user_id", "item_id", "n", "user_mean", (F.col("_sum") / F.col("_rated") - F.col("user_mean")).alias("_dev")
    )
    means = centred.groupBy("item_id").agg(F.avg("_dev").alias("item_dev"))
    return centred.join(means, "item_id").select(
        "user_id", "item_id", "n", "user_mean", "item_dev", (F.col("_dev") - F.col("item_dev")).alias("e")
    )


def user_terms(cells: DataFrame) -> DataFrame:
    """(user_id, half, norm): M/2 + a and the length of the filled row."""
    item_devs = cells.groupBy("item_id").agg(F.first("item_dev").alias("m"))
    big_m = item_devs.agg(F.sum(F.col("m") * F.col("m")).alias("M")).scalar()
    sums = cells.groupBy("user_id").agg(
        F.sum(F.col("item_dev") * F.col("e")).alias("a"), F.sum(F.col("e") * F.col("e")).alias("ee")
    )
    return sums.select(
        "user_id",
        (big_m / 2 + F.col("a")).alias("half"),
        F.sqrt(F.greatest(F.lit(0.0), big_m + 2 * F.col("a") + F.col("ee"))).alias("norm"),
    )


def common_sums(rows_a, items_a, e_a, n_a, rows_b, items_b, e_b, n_b, n_items) -> np.ndarray:
    """Sum of e_u e_v over common items, for all user pairs of two blocks."""
    out = np.zeros((n_a, n_b))
    order_a, order_b = np.argsort(items_a, kind="stable"), np.argsort(items_b, kind="stable")
    rows_a, items_a, e_a = rows_a[order_a], items_a[order_a], e_a[order_a]
    rows_b, items_b, e_b = rows_b[order_b], items_b[order_b], e_b[order_b]
    count_a, count_b = np.bincount(items_a, minlength=n_items), np.bincount(items_b, minlength=n_items)
    start_b = np.concatenate([[0], np.cumsum(count_b)[:-1]])
    # items that most users of both blocks have: dense columns, a few hundred at a time
    dense = np.flatnonzero(count_a * count_b > DENSE_PAIRS)
    for part in np.array_split(dense, math.ceil(len(dense) / 512)) if len(dense) else []:
        column = np.full(n_items, -1)
        column[part] = np.arange(len(part))
        in_a, in_b = column[items_a] >= 0, column[items_b] >= 0
        left, right = np.zeros((n_a, len(part))), np.zeros((n_b, len(part)))
        left[rows_a[in_a], column[items_a[in_a]]] = e_a[in_a]
        right[rows_b[in_b], column[items_b[in_b]]] = e_b[in_b]
        out += left @ right.T
    # all other items: expand the matching cells, a bounded number of pairs at a time
    reach = np.where(count_a * count_b > DENSE_PAIRS, 0, count_b)[items_a]
    ends = np.cumsum(reach)
    first = 0
    while first < len(reach):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + PAIRS_AT_ONCE, side="right")))
        width = reach[first:last]
        total = int(width.sum())
        if total:
            left = np.repeat(np.arange(first, last), width)
            within = np.arange(total) - np.repeat(np.cumsum(width) - width, width)
            right = start_b[items_a[left]] + within
            out += np.bincount(
                rows_a[left] * n_b + rows_b[right], weights=e_a[left] * e_b[right], minlength=n_a * n_b
            ).reshape(n_a, n_b)
        first = last
    return out


def _nearest_of_cell(k: int, digits: int, both_ways: bool = True):
    def nearest(cell: pa.Table) -> pa.Table:
        kind = cell["kind"].to_numpy()
        mirrored = cell["mirrored"][0].as_py()  # a block with itself comes once

        def side(number: int):
            terms = cell.filter(pa.array(kind == 2 * number))
            rated = cell.filter(pa.array(kind == 2 * number + 1))
            ids, order = id_ranks(terms["user_id"])
            rows = pa.compute.index_in(rated["user_id"].combine_chunks(), ids).to_numpy()
            return ids, order, terms["x"].to_numpy(), terms["y"].to_numpy(), rows, rated

        a = side(0)
        b = a if mirrored else side(1)
        codes = pa.concat_arrays([a[5]["item_id"].combine_chunks(), b[5]["item_id"].combine_chunks()])
        codes = codes.dictionary_encode()
        numbers, n_items = codes.indices.to_numpy(), len(codes.dictionary)
        cut = len(a[5])
        sims = common_sums(
            a[4], numbers[:cut], a[5]["x"].to_numpy(), len(a[0]),
            b[4], numbers[cut:], b[5]["x"].to_numpy(), len(b[0]), n_items,
        )
        sims += a[2][:, None]
        sims += b[2][None, :]
        size = a[3][:, None] * b[3][None, :]
        sims = np.divide(sims, size, out=np.zeros_like(sims), where=size > 0)
        if mirrored:
            np.fill_diagonal(sims, 0.0)
        rows, cols, values = best_per_row(sims, b[1], k, digits)
        users, others, scores = [a[0].take(rows)], [b[0].take(cols)], [values]
        if not mirrored and both_ways:
            rows, cols, values = best_per_row(np.ascontiguousarray(sims.T), a[1], k, digits)
            users.append(b[0].take(rows))
            others.append(a[0].take(cols))
            scores.append(values)
        return pa.table(
            {
                "user_id": pa.concat_arrays(users),
                "neighbour": pa.concat_arrays(others),
                "sim": np.concatenate(scores),
            }
        )

    return nearest


def _ordered_blocks(cells: DataFrame, blocks: int | None) -> tuple[DataFrame, list[float]]:
    """(user_id, half, norm, p, q, block, place): users in order of the similarity that needs no items; and the places of h,
    between which ``place`` says the user's h lies."""
    terms = durable(user_terms(cells))
    head = terms.agg(
        F.count(F.lit(1)).alias("n"), F.avg("half").alias("half"), F.min("half").alias("low"), F.max("half").alias("high")
    ).first()
    if blocks is None:
        wanted = math.ceil(math.sqrt(6 * terms.sparkSession.sparkContext.defaultParallelism))
        blocks = min(max(1, math.ceil(head["n"] / USER_BLOCK), wanted), max(1, head["n"]))
    size = max(1, math.ceil(head["n"] / blocks))
    has = F.col("norm") > 0
    zero = F.lit(0.0)
    scored = terms.withColumn("p", F.when(has, F.col("half") / F.col("norm")).otherwise(zero)).withColumn(
        "q", F.when(has, 1 / F.col("norm")).otherwise(zero)
    )
    centre = F.lit(head["half"] or 0.0)
    placed = numbered(scored.withColumn("_score", centre * F.col("q") + F.col("p")), F.desc("_score"), "user_id")
    places = [float(h) for h in np.linspace(head["low"] or 0.0, head["high"] or 0.0, PLACES + 1)]
    below = sum((F.col("half") >= h).cast("int") for h in places[1:-1]) + F.lit(0)
    block = F.floor(F.col("index") / size).cast("int").alias("block")
    return durable(placed.select("user_id", "half", "norm", "p", "q", block, below.alias("place"))), places


def _schema(cells: DataFrame) -> T.StructType:
    user_type = cells.schema["user_id"].dataType
    return T.StructType(
        [
            T.StructField("user_id", user_type),
            T.StructField("neighbour", user_type),
            T.StructField("sim", T.DoubleType()),
        ]
    )


def _rows(placed: DataFrame, cells: DataFrame) -> DataFrame:
    """(user_id, block, item_id, x, y, what): the two numbers of each user, and its rated cells."""
    item_type = cells.schema["item_id"].dataType
    return durable(
        placed.select(
            "user_id", "block", F.lit(None).cast(item_type).alias("item_id"), F.col("half").alias("x"), F.col("norm").alias("y"),
            F.lit(0).alias("what"),
        ).unionByName(
            cells.join(placed.select("user_id", "block"), "user_id").select(
                "user_id", "block", "item_id", F.col("e").alias("x"), F.lit(0.0).alias("y"), F.lit(1).alias("what")
            )
        )
    )


def _in_cells(met: DataFrame, n: int, k: int, digits: int, both_ways: bool) -> DataFrame:
    schema = _schema(met.withColumnRenamed("x", "e"))
    return by_cell(met, n).groupBy("cell").applyInArrow(_nearest_of_cell(k, digits, both_ways), schema)


def _compared(rows: DataFrame, pairs: list[tuple[int, int]], k: int, digits: int) -> DataFrame:
    """(user_id, neighbour, sim): the k best of every user from each of the block pairs (a <= b), for both directions."""
    sides = [(a, cell, 0, a == b) for cell, (a, b) in enumerate(pairs)]
    sides += [(b, cell, 2, False) for cell, (a, b) in enumerate(pairs) if a != b]
    sides = rows.sparkSession.createDataFrame(sides, "block int, cell int, side int, mirrored boolean")
    met = rows.join(sides, "block").select(
        "cell", "mirrored", (F.col("side") + F.col("what")).alias("kind"), "user_id", "item_id", "x", "y"
    )
    return _in_cells(met, len(pairs), k, digits, True)


def _met(rows: DataFrame, wanted: DataFrame, k: int, digits: int) -> DataFrame:
    """(user_id, neighbour, sim): the k best that each user finds in the blocks it has to meet; ``wanted`` is (user_id, own,
    block)."""
    spark = rows.sparkSession
    pairs = sorted((r["own"], r["block"]) for r in wanted.select("own", "block").distinct().collect())
    if not pairs:
        return spark.createDataFrame([], _schema(rows.withColumnRenamed("x", "e")))
    numbers = spark.createDataFrame([(a, b, cell) for cell, (a, b) in enumerate(pairs)], "own int, block int, cell int")
    columns = ["cell", F.lit(False).alias("mirrored"), "user_id", "item_id", "x", "y"]
    asking = rows.drop("block").join(wanted, "user_id").join(F.broadcast(numbers), ["own", "block"])
    asked = rows.join(F.broadcast(numbers), "block")
    met = asking.select(*columns, F.col("what").alias("kind")).unionByName(asked.select(*columns, (F.col("what") + 2).alias("kind")))
    return _in_cells(met, len(pairs), k, digits, False)


def _best(lists: DataFrame, k: int) -> DataFrame:
    best_first = W.partitionBy("user_id").orderBy(F.desc("sim"), "neighbour")
    return lists.withColumn("place", F.row_number().over(best_first)).where(F.col("place") <= k)


def _to_meet(most: np.ndarray, first: int):
    """(user_id, own, block): the blocks, besides those met already, that may beat what a user (user_id, block, place, need)
    needs. ``most`` (blocks, places) is the largest h q + p of a block between two places of h."""
    order = np.argsort(-most, axis=0, kind="stable")
    falling = np.take_along_axis(-most, order, axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, place, need = (batch.column(c).to_numpy() for c in ("block", "place", "need"))
            users, blocks = [], []
            for j in np.unique(place):
                here = np.flatnonzero((place == j) & (own >= first))
                reach = np.searchsorted(falling[:, j], -need[here], side="right")
                user = np.repeat(here, reach)
                block = order[np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach), j]
                new = (block >= first) & (block != own[user])
                users.append(user[new])
                blocks.append(block[new])
            user = np.concatenate(users) if users else np.empty(0, dtype=np.int64)
            block = np.concatenate(blocks) if blocks else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("user_id").take(pa.array(user)), pa.array(own[user].astype(np.int32)), pa.array(block.astype(np.int32))],
                names=["user_id", "own", "block"],
            )

    return run


def _lifted(users: DataFrame, cells: DataFrame, most: np.ndarray, first: int, wanted: DataFrame) -> DataFrame:
    """(user_id, neighbour, sim) of users with common items in blocks that a user does not meet, where these may lift the
    similarity over its k-th best."""
    spark = cells.sparkSession
    rated = durable(
        cells.select("user_id", "item_id", "e").join(users.select("user_id", "p", "q", "block", "place", "need"), "user_id")
    )
    lists = rated.groupBy("item_id", "block").agg(F.max(F.col("e") * F.col("q")).alias("top"), F.min(F.col("e") * F.col("q")).alias("low"))
    ranges = spark.createDataFrame([(b, row.tolist()) for b, row in enumerate(most)], "block int, most array<double>")
    gain = F.greatest(F.col("e") * F.col("top"), F.col("e") * F.col("low"), F.lit(0.0))
    offers = (
        rated.where(F.col("block") >= first).withColumnRenamed("block", "own")
        .join(lists.where(F.col("block") >= first), "item_id").where("own != block")
        .groupBy("user_id", "block").agg(F.sum(gain).alias("gain"), F.first("place").alias("place"), F.first("need").alias("need"))
    )
    asked = durable(
        offers.where("gain > 0").join(F.broadcast(ranges), "block")
        .where(F.get("most", F.col("place")) + F.col("gain") >= F.col("need"))
        .select("user_id", "block").join(wanted.select("user_id", "block"), ["user_id", "block"], "left_anti")
    )
    other = rated.select(
        F.col("user_id").alias("neighbour"), "item_id", F.col("e").alias("e_v"), F.col("p").alias("p_v"), F.col("q").alias("q_v"), "block"
    )
    own = rated.select("user_id", "item_id", "e", "p", "q").join(asked, "user_id")
    sums = own.join(other, ["item_id", "block"]).groupBy("user_id", "neighbour").agg(
        F.sum(F.col("e") * F.col("e_v")).alias("s"),
        *[F.first(c).alias(c) for c in ("p", "q", "p_v", "q_v")],
    )
    sim = F.col("p") * F.col("q_v") + F.col("q") * F.col("p_v") + F.col("q") * F.col("q_v") * F.col("s")
    return sums.select("user_id", "neighbour", rounded(sim).alias("sim"))


def nearest_users(cells: DataFrame, k: int = NEIGHBOURS, digits: int = 6, blocks: int | None = None) -> DataFrame:
    """(user_id, neighbour, sim, place): the k most similar users, a user's own similarity being 0.

    Blocks of users meet in tasks of their own, and a task keeps k per user, so that few pairs leave it. A user does not meet
    blocks that cannot hold one of its k best.
    """
    placed, places = _ordered_blocks(cells, blocks)
    rows = _rows(placed, cells)
    n = (placed.agg(F.max("block")).first()[0] or 0) + 1
    first = min(FIRST_BLOCKS, n)
    pairs = sorted({(min(a, b), max(a, b)) for a in range(n) for b in (*range(first), a)})
    lists = durable(_compared(rows, pairs, k, digits))
    if len(pairs) == n * (n + 1) // 2:
        return _best(lists, k)
    kth = _best(lists, k).where(F.col("place") == k).select("user_id", F.col("sim").alias("kth"))
    # without a k-th best, or without a length, a user needs everyone
    need = F.when(F.col("kth").isNotNull() & (F.col("q") > 0), (F.col("kth") - SLACK) / F.col("q")).otherwise(F.lit(-math.inf))
    users = durable(placed.join(kth, "user_id", "left").withColumn("need", need))
    at = [F.max(F.lit(h) * F.col("q") + F.col("p")).alias(f"most_{j}") for j, h in enumerate(places)]
    ranges = placed.groupBy("block").agg(*at).orderBy("block").collect()  # a few numbers per block of users
    at_places = np.array([[r[f"most_{j}"] for j in range(PLACES + 1)] for r in ranges])
    most = np.maximum(at_places[:, :-1], at_places[:, 1:])
    schema = T.StructType([placed.schema["user_id"], T.StructField("own", T.IntegerType()), T.StructField("block", T.IntegerType())])
    wanted = durable(users.select("user_id", "block", "place", "need").mapInArrow(_to_meet(most, first), schema))
    lists = lists.unionByName(durable(_met(rows, wanted, k, digits)))
    lists = lists.unionByName(_lifted(users, cells, most, first, wanted))
    return _best(lists, k)


def predictions(cells: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(user_id, item_id, n_seen, score) for every item of the neighbours that the user has not rated.

    score = user mean + item mean + sum(e sim) / sum(sim): the item's mean stands in for neighbours that
    have not rated it, so those need no rows. The user's own items ride along as marked rows, which
    removes them in the same aggregation.
    """
    sims = F.sum("sim").over(W.partitionBy("user_id"))  # at most k rows per user
    near = neighbours.select("user_id", "neighbour", "sim", sims.alias("sim_sum"))
    near = near.where(F.col("neighbour") != F.col("user_id"))
    rated = cells.select(F.col("user_id").alias("neighbour"), "item_id", "n", "item_dev", "e")
    offered = near.join(rated, "neighbour").select(
        "user_id", "item_id", "n", "item_dev", "sim_sum", (F.col("e") * F.col("sim")).alias("part"),
        F.lit(0).alias("own"),
    )
    own = cells.select(
        "user_id", "item_id", F.lit(0).cast("bigint").alias("n"), "item_dev", F.lit(0.0).alias("sim_sum"),
        F.lit(0.0).alias("part"), F.lit(1).alias("own"),
    )
    means = cells.groupBy("user_id").agg(F.first("user_mean").alias("user_mean"))
    return (
        offered.unionByName(own)
        .groupBy("user_id", "item_id")
        .agg(
            F.sum("n").alias("n_seen"),
            F.max("item_dev").alias("item_dev"),
            F.max("sim_sum").alias("sim_sum"),
            F.sum("part").alias("part"),
            F.max("own").alias("own"),
        )
        .where(F.col("own") == 0)
        .join(means, "user_id")
        .select(
            "user_id",
            "item_id",
            "n_seen",
            rounded(
                F.col("user_mean") + F.col("item_dev") + F.col("part") / F.nullif(F.col("sim_sum"), F.lit(0.0))
            ).alias("score"),
        )
    )


def fit(train: DataFrame, k: int = NEIGHBOURS, blocks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rated cells and the k nearest users of everyone."""
    cells = durable(deviations(train))
    return cells, nearest_users(cells, k, blocks=blocks)


def user_based_lists(train: DataFrame, n: int, k: int = NEIGHBOURS, blocks: int | None = None) -> DataFrame:
    """(user_id, item_rank, item_id, score): items seen most often among the neighbours come first."""
    return lists_of(*fit(train, k, blocks), n)


def lists_of(cells: DataFrame, near: DataFrame, n: int) -> DataFrame:
    scored = predictions(cells, near)
    best_first = W.partitionBy("user_id").orderBy(F.desc("n_seen"), F.desc_nulls_last("score"), "item_id")
    return (
        scored.withColumn("_place", F.row_number().over(best_first))
        .where(F.col("_place") <= n)
        .select("user_id", (F.col("_place") - 1).alias("item_rank"), "item_id", "score")
    )


def predicted_ratings(train: DataFrame, pairs: DataFrame, k: int = NEIGHBOURS, blocks: int | None = None) -> DataFrame:
    """Predicted ratings of given (user_id, item_id) pairs, by the rule of the lists."""
    cells = durable(deviations(train))
    near = nearest_users(cells, k, blocks=blocks).join(pairs.select("user_id").distinct(), "user_id", "left_semi")
    sums = near.groupBy("user_id").agg(F.sum("sim").alias("sim_sum"))
    means = cells.groupBy("user_id").agg(F.first("user_mean").alias("user_mean"))
    devs = cells.groupBy("item_id").agg(F.first("item_dev").alias("item_dev"))
    rated = cells.select(F.col("user_id").alias("neighbour"), "item_id", "e")
    parts = (
        pairs.join(near, "user_id")
        .join(rated, ["neighbour", "item_id"])
        .groupBy("user_id", "item_id")
        .agg(F.sum(F.col("e") * F.col("sim")).alias("part"))
    )
    return (
        pairs.join(sums, "user_id")
        .join(means, "user_id")
        .join(devs, "item_id")
        .join(parts, ["user_id", "item_id"], "left")
        .select(
            "user_id",
            "item_id",
            rounded(
                F.col("user_mean") + F.col("item_dev")
                + F.coalesce("part", F.lit(0.0)) / F.nullif(F.col("sim_sum"), F.lit(0.0))
            ).alias("predicted"),
        )
    )


def common_items(reviews: DataFrame, user: object, other: object, columns: tuple[str, ...] = ("item_id", "title")) -> DataFrame:
    """Items two users have both reviewed; repeats multiply."""
    a = reviews.where(F.col("user_id") == F.lit(user)).select(*columns)
    b = reviews.where(F.col("user_id") == F.lit(other)).select(*columns)
    return a.join(b, list(columns)).select(*columns)
