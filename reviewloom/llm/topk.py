"""Exact nearest vectors by inner product of integer components: tiles, partial selection, merging as a tree."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.operators.cells import by_cell
from reviewloom.session import durable

QUERY_ROWS, SHARD_ROWS = 4_096, 65_536  # most rows of a tile's sides, on average
SCORES = 4_000_000  # scores of a tile held at a time
FAN = 16  # lists of one query that are merged at a time
EXACT = 2.0**53  # below this, doubles hold integers exactly
LONGEST = (1 << 63) - 1

LISTS = "query_block int, shard int, query_id long, query_key long, vec_id long, score long"


def quantised(vectors: DataFrame, vec_id: str, vector: str, scale: int = 256) -> DataFrame:
    """(vec_id, v): ``floor(scale * x)`` of each component, for rows whose vector is whole.

    Rows with a null id, a null vector, or a null, NaN or infinite component are left out.
    """
    whole = F.col("v").isNotNull() & ~F.exists(
        "v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    )
    return (
        vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
        .where(F.col("vec_id").isNotNull() & whole)
        # doubles of whole numbers; floor() itself would cut at the range of long
        .select("vec_id", F.transform("v", lambda x: _floor(x * scale)).alias("v"))
    )


def _floor(x):
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def products(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers, exact; what does not fit is cut at the ends of the range."""
    if not queries.shape[1]:
        return np.zeros((len(queries), len(shard)), dtype=np.int64)
    most = np.abs(queries).max(initial=0) * np.abs(shard).max(initial=0) * queries.shape[1]
    if most < EXACT:
        return (queries @ shard.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    exact = whole(queries).dot(whole(shard).T)
    return np.clip(exact, -LONGEST - 1, LONGEST).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest scores of each row, best first, ties to the smaller id.

    A partial selection finds each row's k-th score; all columns that reach it are ordered and cut.
    """
    width = scores.shape[1]
    if width > k:
        kth = np.partition(scores, width - k, axis=1)[:, width - k]
        rows, cols = np.nonzero(scores >= kth[:, None])
    else:
        rows, cols = (x.reshape(-1) for x in np.indices(scores.shape))
    order = np.lexsort((ids[cols], ~scores[rows, cols], rows))  # ~x falls as x rises, over the whole range
    rows, cols = rows[order], cols[order]
    starts = np.searchsorted(rows, np.arange(len(scores)))
    keep = np.arange(len(rows)) - starts[rows] < k
    return rows[keep], cols[keep]


def _by_length(vectors: pa.Array):
    """Places of the vectors of each length, with their matrix."""
    sizes = pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        places = np.flatnonzero(sizes == size)
        flat = vectors.take(pa.array(places)).flatten().to_numpy(zero_copy_only=False)
        yield size, places, flat.reshape(len(places), int(size))


def _tile(k: int):
    def top_of_tile(tile: pa.Table) -> pa.Table:
        tile = tile.combine_chunks()
        kind = tile["is_query"].to_numpy()
        queries, shard = tile.filter(pa.array(kind)), tile.filter(pa.array(~kind))
        out = {name: [] for name in ("query_id", "query_key", "vec_id", "score")}
        if len(queries) and len(shard):
            ids, query_ids = shard["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
            keys = queries["query_key"].to_numpy()
            sides = {n: (p, m) for n, p, m in _by_length(shard["v"].combine_chunks())}
            for size, places, left in _by_length(queries["v"].combine_chunks()):
                if size not in sides:
                    continue
                others, right = sides[size]
                other_ids = ids[others]
                step = max(1, SCORES // len(others))
                for at in range(0, len(places), step):
                    mine = places[at : at + step]
                    scores = products(left[at : at + step], right)
                    # the query's own rows come out among the best, or not at all
                    own = np.isin(other_ids, query_ids[mine])
                    room = k + int(np.bincount(np.searchsorted(*_sorted(other_ids[own]))).max()) if own.any() else k
                    rows, cols = best(scores, other_ids, room)
                    foreign = other_ids[cols] != query_ids[mine][rows]
                    rows, cols = rows[foreign], cols[foreign]
                    starts = np.searchsorted(rows, np.arange(len(mine)))
                    keep = np.arange(len(rows)) - starts[rows] < k
                    rows, cols = rows[keep], cols[keep]
                    out["query_id"].append(query_ids[mine][rows])
                    out["query_key"].append(keys[mine][rows])
                    out["vec_id"].append(other_ids[cols])
                    out["score"].append(scores[rows, cols])
        columns = {n: np.concatenate(x) if x else np.empty(0, dtype=np.int64) for n, x in out.items()}
        n = len(columns["score"])
        blocks = {c: np.full(n, tile[c][0].as_py() if len(tile) else 0, dtype=np.int32) for c in ("query_block", "shard")}
        return pa.table({**blocks, **columns})

    return top_of_tile


def _sorted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(ids), ids


def _merge(k: int):
    def merge(lists: pa.Table) -> pa.Table:
        lists = lists.combine_chunks()
        order = np.lexsort((
            lists["vec_id"].to_numpy(), ~lists["score"].to_numpy(), lists["query_key"].to_numpy(),
            lists["query_id"].to_numpy(),
        ))
        lists = lists.take(pa.array(order))
        ids, keys = lists["query_id"].to_numpy(), lists["query_key"].to_numpy()
        fresh = np.ones(len(ids), dtype=bool)
        fresh[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(ids)), 0))
        return lists.filter(pa.array(np.arange(len(ids)) - start < k))

    return merge


def tiles_for(n_queries: int, n_rows: int, tasks: int) -> tuple[int, int]:
    """Query blocks and shards: small enough for memory, and enough tiles for every task."""
    query_blocks, shards = max(1, math.ceil(n_queries / QUERY_ROWS)), max(1, math.ceil(n_rows / SHARD_ROWS))
    if query_blocks * shards < tasks:
        shards = min(math.ceil(tasks / query_blocks), max(1, n_rows // 256))
    return query_blocks, max(1, shards)


def top_k(queries: DataFrame, rows: DataFrame, k: int = 5, tiles: tuple[int, int] | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products, ties to the smaller vec_id.

    Both sides are (vec_id, v), v an array of whole numbers as doubles. Each tile multiplies a block of queries by
    a shard of rows and hands on k rows per query; lists of a query are merged ``FAN`` at a time until one is left.
    Only the two row counts reach the driver. A query meets every row but those with its own id, and
    only rows of its own length; with fewer than k such rows its list is shorter. Repeated rows are rows of
    their own, and can both be listed; a query repeated with the same vector counts once, and one id with
    two vectors gives two lists.
    """
    rows = durable(rows.select("vec_id", "v"))
    queries = durable(queries.select("vec_id", "v").distinct())
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    query_blocks, shards = tiles or tiles_for(queries.count(), rows.count(), tasks)
    sides = queries.select(
        F.lit(True).alias("is_query"),
        F.pmod(F.xxhash64("vec_id", "v"), F.lit(query_blocks)).cast("int").alias("query_block"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
        "vec_id", F.xxhash64("v").alias("query_key"), "v",
    ).unionByName(
        rows.select(
            F.lit(False).alias("is_query"),
            F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"),
            F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"),
            "vec_id", F.lit(0).cast("long").alias("query_key"), "v",
        )
    )
    cells = by_cell(sides.withColumn("cell", F.col("query_block") * shards + F.col("shard")), query_blocks * shards)
    lists = cells.groupBy("cell").applyInArrow(_tile(k), LISTS)
    while shards > 1:
        shards = math.ceil(shards / FAN)
        lists = (
            lists.withColumn("shard", F.floor(F.col("shard") / FAN).cast("int"))
            # a block's lists are cut by query, so that a group stays small
            .withColumn("part", F.pmod(F.xxhash64("query_id", "query_key"), F.lit(8)).cast("int"))
            .groupBy("query_block", "shard", "part")
            .applyInArrow(_merge_part(k), LISTS)
        )
    ranked = lists.groupBy("query_id", "query_key").agg(
        F.sort_array(F.collect_list(F.struct(F.bitwise_not("score").alias("order"), "vec_id", "score"))).alias("best")
    )  # k entries per query
    return ranked.select("query_id", F.posexplode("best").alias("place", "entry")).select(
        "query_id", (F.col("place") + 1).alias("rank"), F.col("entry.vec_id").alias("vec_id"),
        F.col("entry.score").alias("score"),
    )


def _merge_part(k: int):
    merge = _merge(k)

    def run(lists: pa.Table) -> pa.Table:
        return merge(lists.drop_columns(["part"]))

    return run
