import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.operators import baseline, content, evaluate, factorise, grid, neighbours, paragraph, recommend, split


def test_split_sizes_and_ties(spark):
    rows = []
    for user, n in (("one", 1), ("three", 3), ("ten", 10), ("ninety", 90)):
        rows += [(len(rows) + i, user, "item", f"2020-01-{1 + i // 5:02d}") for i in range(n)]
    reviews = spark.createDataFrame(rows, "review_id long, user_id string, item_id string, d string")
    reviews = reviews.withColumn("review_date", F.to_date("d")).drop("d")
    train, test = split.split_train_test(reviews)
    assert {r["user_id"]: r["count"] for r in train.groupBy("user_id").count().collect()} == {"three": 2, "ten": 7, "ninety": 62}
    assert {r["user_id"]: r["count"] for r in test.groupBy("user_id").count().collect()} == {"three": 1, "ten": 3, "ninety": 28}
    ends = train.groupBy("user_id").agg(F.max("review_id").alias("a")).join(test.groupBy("user_id").agg(F.min("review_id").alias("b")), "user_id")
    assert all(r["a"] < r["b"] for r in ends.collect())


def dense(train):
    """The filled matrix and user means, the slow way."""
    pdf = train.toPandas()
    pdf["dev"] = pdf["rating"] - pdf.groupby("user_id")["rating"].transform("mean")
    wide = pdf.pivot_table(index="user_id", columns="item_id", values="dev")
    return wide.fillna(wide.mean(axis=0)), pdf.groupby("user_id")["rating"].mean(), pdf


@pytest.mark.parametrize("blocks", [1, 3])
def test_neighbours_match_dense(spark, small_train, blocks):
    filled, _, _ = dense(small_train)
    m = filled.to_numpy()
    size = np.linalg.norm(m, axis=1)
    sims = m @ m.T / np.outer(size, size)
    np.fill_diagonal(sims, 0)
    got = neighbours.nearest_users(neighbours.deviations(small_train), 10, blocks=blocks).collect()
    assert len(got) == 16
    users = list(filled.index)
    for r in got:
        assert r["sim"] == pytest.approx(sims[users.index(r["user_id"]), users.index(r["neighbour"])], abs=1e-6)


def test_common_sums_both_ways(monkeypatch):
    rng = np.random.default_rng(1)
    a, b = rng.random((30, 40)) * (rng.random((30, 40)) < 0.3), rng.random((20, 40)) * (rng.random((20, 40)) < 0.3)
    ra, ia = np.nonzero(a)
    rb, ib = np.nonzero(b)
    for dense_from, at_once in ((10**9, 17), (20, 10**6), (0, 5)):
        monkeypatch.setattr(neighbours, "DENSE_PAIRS", dense_from)
        monkeypatch.setattr(neighbours, "PAIRS_AT_ONCE", at_once)
        got = neighbours.common_sums(ra, ia, a[ra, ia], 30, rb, ib, b[rb, ib], 20, 40)
        assert np.allclose(got, a @ b.T)


def test_user_based_scores(spark, small_train):
    filled, means, pdf = dense(small_train)
    near = {}
    cells = neighbours.deviations(small_train)
    for r in neighbours.nearest_users(cells, 2).collect():
        near.setdefault(r["user_id"], {})[r["neighbour"]] = r["sim"]
    owned = pdf.groupby("user_id")["item_id"].apply(set)
    got = recommend.recommend("ub-cf", small_train, 10, k=2).collect()
    assert got
    for r in got:
        u, i = r["user_id"], r["item_id"]
        assert i not in owned[u]
        want = means[u] + sum(filled.loc[v, i] * s for v, s in near[u].items()) / sum(near[u].values())
        assert r["score"] == pytest.approx(want, abs=1e-5)


def test_sgd_matches_plain_loop(spark, small_train):
    rng = np.random.default_rng(0)
    users, items = sorted({r["user_id"] for r in small_train.collect()}), list("abcde")
    p, q = rng.normal(size=(4, 3)), rng.normal(size=(5, 3))
    model = factorise.fit(
        small_train,
        spark.createDataFrame([(u, v.tolist()) for u, v in zip(users, p)], "user_id string, vec array<double>"),
        spark.createDataFrame([(i, v.tolist()) for i, v in zip(items, q)], "item_id string, vec array<double>"),
        epochs=3, rate=0.05, reg=0.1, blocks=1,
    )
    rows = sorted(small_train.collect(), key=lambda r: (r["user_id"], r["review_id"]))
    mean, bu, bi = np.mean([r["rating"] for r in rows]), np.zeros(4), np.zeros(5)
    for _ in range(3):
        for r in rows:
            u, i = users.index(r["user_id"]), items.index(r["item_id"])
            err = r["rating"] - (mean + bu[u] + bi[i] + p[u] @ q[i])
            bu[u] += 0.05 * (err - 0.1 * bu[u])
            bi[i] += 0.05 * (err - 0.1 * bi[i])
            p[u], q[i] = p[u] + 0.05 * (err * q[i] - 0.1 * p[u]), q[i] + 0.05 * (err * p[u] - 0.1 * q[i])
    for r in model.users.collect():
        assert np.allclose(r["vec"], p[users.index(r["user_id"])]) and r["bias"] == pytest.approx(bu[users.index(r["user_id"])])
    pairs = spark.createDataFrame([("u1", "e"), ("u1", "zz"), ("nobody", "zz")], "user_id string, item_id string")
    est = {(r["user_id"], r["item_id"]): r["score"] for r in model.estimate(pairs, clip=False).collect()}
    assert est[("nobody", "zz")] == pytest.approx(mean, abs=1e-6)
    assert est[("u1", "zz")] == pytest.approx(mean + bu[0], abs=1e-6)
    assert est[("u1", "e")] == pytest.approx(mean + bu[0] + bi[4] + p[0] @ q[4], abs=1e-6)
    lists = model.recommend(5, small_train).collect()
    assert all(1.0 <= r["score"] <= 5.0 for r in lists)


@pytest.mark.parametrize("blocks", [None, (1, 1), (3, 2)])
def test_grid_clips_ties_and_leaves_out_seen(spark, blocks):
    users = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "user_id long, vec array<double>")
    items = spark.createDataFrame([(i, [float(i), float(-i)]) for i in range(1, 8)], "item_id long, vec array<double>")
    seen = spark.createDataFrame([(1, 5)], "user_id long, item_id long")
    got = grid.grid_top_k(users, items, 3, grid.dot_scorer(0.0, (1.0, 5.0)), seen, blocks=blocks)
    lists = {u: [(r["item_id"], r["score"]) for r in sorted(got.where(F.col("user_id") == u).collect(), key=lambda r: r["item_rank"])] for u in (1, 2)}
    assert lists[1] == [(6, 5.0), (7, 5.0), (4, 4.0)]  # clipped scores tie, the lower id leads
    assert lists[2] == [(1, 1.0), (2, 1.0), (3, 1.0)]


def test_content_candidates_are_cut_first(spark):
    train = spark.createDataFrame([(1, 1, 1), (2, 1, 2)], "review_id long, user_id long, item_id long")
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.1]), (4, [0.0, 1.0])], "item_id long, vec array<double>")
    got = content.embedded_review_lists(train, items, 10, candidates=3).collect()
    assert [(r["item_rank"], r["item_id"]) for r in got] == [(0, 3)]  # a short list is returned as it is


def test_random_lists_do_not_depend_on_blocks(spark, small_train):
    a = sorted(map(tuple, baseline.random_lists(small_train, 3, blocks=(1, 1)).collect()))
    b = sorted(map(tuple, baseline.random_lists(small_train.repartition(3), 3, blocks=(3, 2)).collect()))
    assert a == b and a


def test_metrics(spark):
    test = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 1), ("c", 9), ("d", 1)], "user_id string, item_id int")
    recs = spark.createDataFrame(
        [("a", 0, 1), ("a", 1, 2), ("a", 2, 3), ("b", 0, 1), ("c", 0, 77), ("e", 0, 1)], "user_id string, item_rank int, item_id int"
    )
    popularity = spark.createDataFrame([(1, 1.0), (2, 0.5), (3, 0.25)], "item_id int, popularity double")
    got = {r["user_id"]: r for r in evaluate.per_user_metrics(recs, test, popularity, (2,)).collect()}
    assert set(got) == {"a", "b", "c"}  # d has no list, e has no test rows
    assert got["a"]["recall"] == 1.0 and got["a"]["novelty"] == pytest.approx((2 - 1.5) / 2)
    assert got["b"]["recall"] == 0.5  # a repeated test item counts twice below the line
    assert got["b"]["novelty"] == pytest.approx(0.5) and got["b"]["precision"] == 0.5  # short list
    assert got["c"]["recall"] == 0.0 and got["c"]["novelty"] == 1.0


def test_unknown_algorithm(small_train):
    with pytest.raises(ValueError, match="unknown algorithm"):
        recommend.recommend("MAGIC", small_train, 5)
    with pytest.raises(ValueError, match="item_vectors"):
        recommend.recommend("ER-CBF", small_train, 5)


def test_two_title_items_double(spark):
    lists = spark.createDataFrame([("u", 0, "i", 1.0)], "user_id string, item_rank int, item_id string, score double")
    titles = spark.createDataFrame([("i", "A"), ("i", "B"), ("i", "A")], "item_id string, title string")
    assert recommend.recommendations_table(lists, titles, "er-cbf").count() == 2


def planted_documents(seed=3):
    """40 documents about two things in turn, with filler words both share: tokens and document numbers."""
    rng = np.random.default_rng(seed)
    tokens = []
    for n in range(40):
        own = (n % 2) * 12 + rng.integers(0, 12, 60)
        tokens.append(np.where(rng.random(60) < 0.6, 24 + rng.integers(0, 40, 60), own))
    return np.concatenate(tokens), np.repeat(np.arange(40), 60), rng


def test_paragraph_kernel_finds_planted_topics(monkeypatch):
    monkeypatch.setattr(paragraph, "SAMPLE", 1.0)
    tokens, doc, rng = planted_documents()
    counts, dim, epochs = np.bincount(tokens, minlength=64).astype(float), 8, 40
    vec_in, vec_out, tags = (rng.random((64, dim)) - 0.5) / dim, np.zeros((64, dim)), (rng.random((40, dim)) - 0.5) / dim
    for e in range(epochs):
        paragraph.learn(vec_in, vec_out, tags, tokens, doc, doc, counts, len(tokens), 0.025 * (1 - e / epochs), rng, dim)
    unit = tags / np.linalg.norm(tags, axis=1)[:, None]
    sims = unit @ unit.T
    assert sims[::2, ::2].mean() > sims[::2, 1::2].mean() + 0.3
    frozen, fresh, own = vec_out.copy(), (rng.random((1, dim)) - 0.5) / dim, doc == 0
    for e in range(50):
        paragraph.learn(
            vec_in, vec_out, fresh, tokens[own], doc[own], np.zeros(own.sum(), dtype=int), counts, len(tokens),
            0.025 * (1 - e / 50), rng, dim, False,
        )
    assert np.array_equal(frozen, vec_out)
    near = np.argsort(-(unit @ fresh[0]))[:5]
    assert (near % 2 == 0).all()


def test_paragraph_vectors_on_spark(spark):
    tokens, doc, _ = planted_documents()
    rows = [(n, n // 2, n % 5, " ".join(f"w{w}" for w in tokens[doc == n]), f"t{n // 2}") for n in range(40)]
    reviews = spark.createDataFrame(rows, "review_id long, item_id long, user_id long, processed_text string, title string")
    vectors = paragraph.review_vectors(reviews, ("item", "user"), epochs=2, dim=8, parts=3)
    assert {r["kind"]: r["count"] for r in vectors.groupBy("kind").count().collect()} == {"item": 20, "user": 5}
    assert all(len(r["vec"]) == 8 for r in vectors.collect())
    near = paragraph.similar_items(reviews, 0, n=5, epochs=2, dim=8, parts=3).collect()
    assert sorted(r["item_rank"] for r in near) == [0, 1, 2, 3, 4]
    assert all(r["title"] == f"t{r['item_id']}" for r in near)
