"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.session import durable

MOST_ROUNDS = 60  # a path of n nodes needs about log2(n) rounds
HEAVY, HEAVY_KEYS = 1_000, 100_000  # a node is heavy from so many edges, and from so large a share of all that few can be


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b); ``comp`` is the smallest node reachable.

    Alternates large-star and small-star steps until every node points at the smallest node of its
    component. Each step takes the smallest neighbour of every node, which is summed before the shuffle,
    and joins it back. The neighbours of heavy nodes, of which a table holds about ``2 * HEAVY_KEYS`` at most, are
    joined where they lie, by a broadcast; only those of other nodes are shuffled. No component is gathered anywhere.
    """
    edges = durable(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct())
    before = _state(edges)
    for _ in range(MOST_ROUNDS):
        if not before[0]:
            break
        heavy = max(HEAVY, before[0] // HEAVY_KEYS)
        starred = durable(_large_star(edges, heavy))
        edges = durable(_small_star(starred, heavy).distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    own = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("comp"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(own)


def _state(edges: DataFrame) -> tuple:
    """Number of edges and a digest of all of them."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _with_least(both: DataFrame, heavy: int) -> tuple[DataFrame, DataFrame]:
    """(u, v, least), and (u, least): the smallest v of each u. A u has at most twice as many rows as it has edges."""
    least = durable(both.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("degree")))
    light = both.join(least.where(F.col("degree") <= heavy).select("u", "least"), "u")
    if not least.where(F.col("degree") > heavy).limit(1).count():
        return light, least.select("u", "least")
    few = F.broadcast(least.where(F.col("degree") > heavy).select("u", "least"))
    rest = both.join(F.broadcast(least.where(F.col("degree") > heavy).select("u")), "u", "left_anti")
    light = rest.join(least.where(F.col("degree") <= heavy).select("u", "least"), "u")
    return light.unionByName(both.join(few, "u")), least.select("u", "least")


def _large_star(edges: DataFrame, heavy: int) -> DataFrame:
    """Link each larger neighbour of a node with the smallest node of its neighbourhood."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    joined, _ = _with_least(both, heavy)
    return (
        joined.where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("a"), F.least("least", "u").alias("b"))
        .where(F.col("a") != F.col("b"))
    )


def _small_star(edges: DataFrame, heavy: int) -> DataFrame:
    """Link a node and its smaller neighbours with the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    joined, least = _with_least(down, heavy)
    linked = joined.select(F.col("v").alias("a"), F.col("least").alias("b"))
    own = least.select(F.col("u").alias("a"), F.col("least").alias("b"))
    return linked.unionByName(own).where(F.col("a") != F.col("b"))
