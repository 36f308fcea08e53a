"""Pruned neighbours against all pairs, and how much they compare."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.operators import neighbours


def ratings(spark, users, items, seed, popular=0):
    """Ratings with tastes, some users who rate much and some who rate alike, and a popular item."""
    rng = np.random.default_rng(seed)
    rows = []
    for u in range(users):
        n = int(rng.choice([2, 8, 30])) if u % 10 else 2
        chosen = rng.choice(items, min(n, items), replace=False).tolist() + ([popular] if u % 3 == 0 else [])
        for i in chosen:
            taste = 3 + 1.5 * np.sin(i + (u % 4)) + rng.normal()
            rows.append((len(rows), u, int(i), float(np.clip(round(taste), 1, 5)) if u % 17 else 3.0))
    return spark.createDataFrame(rows, "review_id long, user_id long, item_id long, rating double")


def all_pairs(train, k):
    pdf = train.toPandas()
    pdf["dev"] = pdf["rating"] - pdf.groupby("user_id")["rating"].transform("mean")
    wide = pdf.pivot_table(index="user_id", columns="item_id", values="dev")
    filled = wide.fillna(wide.mean(axis=0)).to_numpy()
    size = np.linalg.norm(filled, axis=1)
    sims = np.divide(filled @ filled.T, np.outer(size, size), out=np.zeros((len(size),) * 2), where=np.outer(size, size) > 0)
    np.fill_diagonal(sims, 0.0)
    return np.round(sims, 6), list(wide.index)


@pytest.mark.parametrize(("users", "items", "blocks", "k"), [(120, 40, 12, 5), (150, 400, 10, 7), (30, 20, 6, 50)])
def test_lists_are_those_of_all_pairs(spark, users, items, blocks, k):
    train = ratings(spark, users, items, seed=users)
    sims, ids = all_pairs(train, k)
    got = neighbours.nearest_users(neighbours.deviations(train), k, blocks=blocks).collect()
    for a, u in enumerate(ids):
        own = sorted((r for r in got if r["user_id"] == u), key=lambda r: r["place"])
        want = sorted(range(len(ids)), key=lambda b: (-sims[a, b], ids[b]))[:k]
        assert [r["place"] for r in own] == list(range(1, len(want) + 1))
        assert np.allclose([r["sim"] for r in own], sims[a, want], atol=2e-6)
        assert len({r["neighbour"] for r in own}) == len(own)
        assert all(abs(sims[a, ids.index(r["neighbour"])] - r["sim"]) < 2e-6 for r in own)


def test_fewer_pairs_than_all(spark, monkeypatch):
    """Compared pairs of users grow slower than their square."""
    compared = []
    real = neighbours._met

    def counting(rows, wanted, k, digits):
        size = rows.where("what = 0").groupBy("block").count()
        first = size.where(F.col("block") < neighbours.FIRST_BLOCKS).first()["count"]
        own = sum(r["count"] ** 2 for r in size.collect())
        met = wanted.join(size, "block").agg(F.sum("count")).first()[0] or 0
        compared.append(2 * first * rows.where("what = 0").count() + own + met)
        return real(rows, wanted, k, digits)

    monkeypatch.setattr(neighbours, "_met", counting)
    for users, blocks in ((200, 10), (800, 40)):
        neighbours.nearest_users(neighbours.deviations(ratings(spark, users, users * 2, seed=2)), 5, blocks=blocks).write.format("noop").mode("overwrite").save()
    print("pairs compared", compared, "of", [200**2, 800**2])
    assert compared[1] < 800**2 / 3 and compared[1] / compared[0] < 13  # 16 if all pairs were


def test_users_without_deviations(spark):
    train = spark.createDataFrame([(i, i % 6, i % 4, 3.0) for i in range(30)], "review_id long, user_id long, item_id long, rating double")
    got = neighbours.nearest_users(neighbours.deviations(train), 2, blocks=3)
    assert {r["sim"] for r in got.collect()} == {0.0}
    assert neighbours.nearest_users(neighbours.deviations(train.where(F.lit(False))), 2).count() == 0
