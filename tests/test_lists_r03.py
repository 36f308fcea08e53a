"""Lists that leave one cell whole, and cuts that matter to few users."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.llm import line_dedup
from reviewloom.operators import content, grid, recommend


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_whole_lists_are_not_shuffled(spark):
    """Lists of 200 items of all users went through a shuffle and a sort, although one task had made each of them."""
    rng = np.random.default_rng(5)
    u, v = rng.integers(-2, 3, (40, 3)).astype(float), rng.integers(-2, 3, (60, 3)).astype(float)
    users = spark.createDataFrame([(i % 35, x.tolist()) for i, x in enumerate(u)], "user_id long, vec array<double>")  # five come twice
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item_id long, vec array<double>")
    nameless = items.withColumn("item_id", F.nullif("item_id", F.lit(7)))
    for seen in (None, spark.createDataFrame([(1, 5), (1, 5), (2, None), (9, 7)], "user_id long, item_id long")):
        whole = grid.grid_top_k(users, items, 6, grid.dot_scorer(), seen, blocks=(3, 1))
        merged = grid.grid_top_k(users, items, 6, grid.dot_scorer(), seen, blocks=(3, 2))
        assert "Window" in plan_of(merged) and "Window" not in plan_of(whole)
        assert sorted(map(str, whole.collect())) == sorted(map(str, merged.collect()))
        whole = grid.grid_top_k(users, nameless, 6, grid.dot_scorer(), seen, blocks=(3, 1))
        ranked = grid.rank_items(whole.drop("item_rank"), 6)
        assert sorted(map(str, whole.collect())) == sorted(map(str, ranked.collect()))


def test_one_block_of_items_unless_lists_are_cheaper_to_move():
    assert grid.block_counts(900_000, 1_200_000, 12, 200)[1] == 1
    assert grid.block_counts(400_000, 1_200_000, 12, 200) == (12, 1)  # (6, 2) before
    assert grid.block_counts(900_000, 1_200_000, 12, 10)[1] > 1


@pytest.mark.parametrize("blocks", [(2, 1), (2, 3)])
def test_candidates_are_kept_for_users_with_many_rated_items_only(spark, monkeypatch, blocks):
    """Every user's list held all candidates, whatever the user had rated."""
    rng = np.random.default_rng(6)
    n_users, n_items, n, candidates = 30, 80, 4, 12
    u, v = rng.normal(size=(n_users, 3)), rng.normal(size=(n_items, 3))
    rated = {(a, int(b)) for a in range(n_users) for b in rng.choice(n_items, 40 if a % 10 == 0 else 2, replace=False)}
    profiles = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(u)], "user_id long, vec array<double>")
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item_id long, vec array<double>")
    seen = spark.createDataFrame(sorted(rated) + [(None, 1), (3, None)], "user_id long, item_id long")
    asked = []
    inner = content.grid_top_k
    monkeypatch.setattr(content, "grid_top_k", lambda users, items, k, *a, **b: asked.append((k, users.count())) or inner(users, items, k, *a, **b))

    def lists(vectors):
        got = content.profile_lists(profiles, vectors, seen, n, candidates, blocks).collect()
        return {a: [r["item_id"] for r in sorted(got, key=lambda r: r["item_rank"]) if r["user_id"] == a] for a in range(n_users)}

    scores = np.round((u @ v.T) / np.linalg.norm(u, axis=1)[:, None] / np.linalg.norm(v, axis=1), 6)
    order = np.argsort(-scores, axis=1, kind="stable")
    assert lists(items) == {a: [i for i in order[a, :candidates].tolist() if (a, i) not in rated][:n] for a in range(n_users)}
    assert sorted(asked) == [(n, 27), (candidates, 3)]
    twice = {a: [i for i in np.repeat(order[a], 2)[:candidates].tolist() if (a, i) not in rated][:n] for a in range(n_users)}
    assert lists(items.unionByName(items)) == twice  # an item that comes twice takes two places


def test_random_lists_take_pairs_as_they_are(spark, small_train):
    """Users, items and pairs each made the distinct pairs of all ratings anew."""
    seen = recommend.fit("RANDOM", small_train).tables["seen"]
    assert "Aggregate" not in plan_of(seen)
    lists = recommend.recommend("RANDOM", small_train, 3).collect()
    assert len(lists) == 2 + 3 + 2 + 3  # five items, of which a user has three, two, three or two
    assert not {(r["user_id"], r["item_id"]) for r in lists} & {(r["user_id"], r["item_id"]) for r in small_train.collect()}


def test_pairs_are_not_looked_up_for_full_lists(monkeypatch):
    """Every step looked up all rated pairs, although no list could change any more."""
    sizes = []
    inner = grid.pa.compute.index_in
    monkeypatch.setattr(grid.pa.compute, "index_in", lambda values, options: sizes.append(len(options)) or inner(values, options))
    rows = [(0, u, None, [9.0]) for u in range(5)] + [(1, 1, 0, None)] + [(2, None, i, [1.0]) for i in range(20_000)]
    kind, user, item, vec = zip(*rows)
    cell = grid.pa.table({
        "kind": grid.pa.array(kind, grid.pa.int32()), "user_id": grid.pa.array(user, grid.pa.int64()),
        "item_id": grid.pa.array(item, grid.pa.int64()), "vec": grid.pa.array(vec, grid.pa.list_(grid.pa.float64())),
    })
    scorer = grid.dot_scorer(clip=(1.0, 5.0))
    found = grid.pa.Table.from_batches(grid._cell(scorer, 10, 6, 5.0, False)(iter(cell.to_batches())))
    assert [r["item_id"] for r in found.to_pylist() if r["user_id"] == 1] == [*range(1, 11)]
    assert sizes == [5, grid.FIRST_TO_FILL * 10]  # and 1,024 items were scored at first


def test_levels_of_line_ranks_are_counted_once(spark, monkeypatch):
    """Whether a level is empty and how large its keys are took a job each."""
    first = spark.createDataFrame([(i, i % 4) for i in range(12)], "place long, rank long")
    asked = []
    inner = line_dedup._sizes
    monkeypatch.setattr(line_dedup, "_sizes", lambda keyed: asked.append(1) or inner(keyed))
    monkeypatch.setattr(type(first), "isEmpty", lambda self: pytest.fail("a job of its own"))
    levels = line_dedup.suffix_ranks(first)
    assert [x.count() for x in levels] == [12, 11, 9, 2] and len(asked) == len(levels)
