"""Least squares, the vector index, the model store, topics on weights, row accounting, small readers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.functions.scalar import cosine
from reviewloom.operators import accounting, als, content, index, paragraph, recommend, serve, topics
from reviewloom.sources import models, readers, writers


def test_als_solves_ridge_problems(spark, small_train, monkeypatch):
    monkeypatch.setattr(als, "MOST_RATINGS", 2)  # every larger row is solved from shares
    rng = np.random.default_rng(0)
    users, items = ["u1", "u2", "u3", "u4"], list("abcde")
    q = rng.normal(size=(5, 3))
    start = spark.createDataFrame([(i, v.tolist()) for i, v in zip(items, q)], "item_id string, vec array<double>")
    model = als.fit(small_train, epochs=3, reg=0.7, blocks=3, item_start=start)
    rows = [(users.index(r["user_id"]), items.index(r["item_id"]), r["rating"]) for r in small_train.collect()]
    mean = np.mean([r[2] for r in rows])
    p, bu, bi = np.zeros((4, 3)), np.zeros(4), np.zeros(5)
    for _ in range(3):
        for left, right, bl, br, a, b in ((p, q, bu, bi, 0, 1), (q, p, bi, bu, 1, 0)):
            for x in range(len(left)):
                own = [r for r in rows if r[a] == x]
                wide = np.array([[*right[r[b]], 1.0] for r in own])
                target = np.array([r[2] - mean - br[r[b]] for r in own])
                answer = np.linalg.solve(wide.T @ wide + 0.7 * np.eye(4), wide.T @ target)
                left[x], bl[x] = answer[:-1], answer[-1]
    got = {r["user_id"]: r for r in model.users.collect()}
    for x, u in enumerate(users):
        assert np.allclose(got[u]["vec"], p[x]) and got[u]["bias"] == pytest.approx(bu[x])
    got = {r["item_id"]: r for r in model.items.collect()}
    for x, i in enumerate(items):
        assert np.allclose(got[i]["vec"], q[x]) and got[i]["bias"] == pytest.approx(bi[x])
    assert model.mean == pytest.approx(mean)
    lists = model.recommend(2, small_train).collect()
    assert lists and not {(r["user_id"], r["item_id"]) for r in lists} & {(r["user_id"], r["item_id"]) for r in small_train.collect()}
    with pytest.raises(ValueError, match="no ratings"):
        als.fit(small_train.where("false"))


def test_als_does_not_depend_on_blocks(spark, small_train):
    fits = [als.fit(small_train.repartition(b), factors=4, epochs=2, blocks=b) for b in (1, 5)]
    a, b = ({r["user_id"]: r["vec"] for r in f.users.collect()} for f in fits)
    assert all(np.allclose(a[u], b[u]) for u in a) and len(a) == 4


def vectors(spark, n, dim=16, seed=1):
    """Vectors around some directions, repeated and zero ones among them."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, dim))
    rows = [(i, (base[i % 12] + rng.normal(size=dim) * 0.8).tolist()) for i in range(n)]
    rows[3], rows[4] = (3, rows[5][1]), (4, [0.0] * dim)
    return spark.createDataFrame(rows, "item_id long, vec array<double>")


def test_index_finds_nearest(spark, monkeypatch):
    items = vectors(spark, 1_500)
    queries = vectors(spark, 120, seed=2).withColumnRenamed("item_id", "user_id")
    true = content.nearest_items(queries, items, 50)
    found = index.build(items, queries, 50)
    assert found.filed.count() == 1_500  # every vector is filed, once
    got = found.nearest(queries, 50)
    assert found.probes < len(found.centres)
    assert index.recall_of(got, true) >= 0.9
    assert {r["n"] for r in got.groupBy("user_id").agg(F.count("*").alias("n")).collect()} == {50}
    # with all lists the answer is exact, also if lists are scored in parts
    monkeypatch.setattr(index, "QUERIES_PER_PART", 7)
    monkeypatch.setattr(index, "LIST_PART", 9)
    exact = found.nearest(queries, 50, probes=len(found.centres))
    assert sorted(map(tuple, exact.select("user_id", "item_rank", "score").collect())) == sorted(map(tuple, true.select("user_id", "item_rank", "score").collect()))
    with pytest.raises(ValueError, match="no item vectors"):
        index.build(items.where("false"), queries)


def test_models_are_kept_and_read_back(spark, small_train, tmp_path):
    items = spark.createDataFrame([(i, [float(n), 1.0, -float(n % 2)]) for n, i in enumerate("abcde")], "item_id string, vec array<double>")
    users = spark.createDataFrame([(u, [0.5, float(n), 0.1]) for n, u in enumerate(("u1", "u2", "u3", "u4"))], "user_id string, vec array<double>")
    for name in recommend.ALGORITHMS:
        settings = {"epochs": 2} if name in ("FUNK-SVD", "ALS", "TI-MF", "MOD-ECF") else {}
        trained = recommend.fit(name.lower(), small_train, user_vectors=users, item_vectors=items, **settings)
        path = str(tmp_path / name)
        assert trained.save(spark, path) == 1
        kept = recommend.Recommender.load(spark, path)
        assert kept.algorithm == name
        want = sorted(map(tuple, trained.recommend(3).collect()))
        assert want and sorted(map(tuple, kept.recommend(3).collect())) == want


def test_only_finished_versions_count(spark, tmp_path):
    path = str(tmp_path / "model")
    with pytest.raises(FileNotFoundError):
        models.load(spark, path)
    one, two = spark.range(1), spark.range(2)
    assert models.save(spark, path, {"t": one}, {"x": 1}) == 1 and models.save(spark, path, {"t": two}, {"x": 2}) == 2
    two.write.parquet(f"{path}/version=3/t")  # a run that did not get to its marker
    tables, params = models.load(spark, path)
    assert tables["t"].count() == 2 and params == {"x": 2}
    assert models.load(spark, path, 1)[0]["t"].count() == 1
    assert models.save(spark, path, {"t": one}) == 4 and models.versions(spark, path) == [1, 2, 4]
    with pytest.raises(FileNotFoundError):
        models.load(spark, path, 3)


def reviews_of_two_things(spark):
    rng = np.random.default_rng(3)
    rows = []
    for n in range(60):
        own = rng.integers(0, 8, 25) + 8 * (n % 2)
        rows.append((n, n % 7, n % 5, " ".join(f"w{chr(97 + w)}x" for w in own), f"t{n % 5}"))
    return spark.createDataFrame(rows, "review_id long, user_id long, item_id long, processed_text string, title string")


def test_review_vectors_are_kept(spark, tmp_path):
    reviews = reviews_of_two_things(spark)
    docs = paragraph.tagged_documents(reviews, ("item",), "processed_text")
    model = paragraph.train(docs, dim=6, epochs=2)
    model.save(spark, str(tmp_path / "vectors"))
    kept = paragraph.ReviewVectors.load(spark, str(tmp_path / "vectors"))
    assert (kept.total, kept.dim) == (model.total, 6)
    a, b = (sorted(map(repr, paragraph.infer(m, docs, epochs=3).collect())) for m in (model, kept))
    assert a == b and len(a) == 5


@pytest.mark.parametrize("weights", [topics.COUNTS, topics.TFIDF])
def test_topics(spark, tmp_path, weights):
    reviews = reviews_of_two_things(spark)
    # terms in half of all reviews have a weight of 1 each, before scaling
    model = topics.train_topics(reviews, topics=2, passes=5, min_docs=1, weights=weights)
    counts = topics.term_counts(reviews, "review_id")
    shares = {r["review_id"]: r["vec"] for r in model.distributions(counts, "review_id").collect()}
    assert all(abs(sum(v) - 1) < 1e-9 for v in shares.values()) and len(shares) == 60
    first = [max(range(2), key=lambda k: shares[n][k]) for n in range(60)]
    assert first == [first[n % 2] for n in range(60)] and first[0] != first[1]
    # as Spark infers them, whose start is drawn
    bags = model.vocabulary.transform(reviews.select("review_id", F.split("processed_text", " ").alias("tokens")))
    for r in model.lda.transform(bags).collect():
        assert np.allclose(shares[r["review_id"]], r["topicDistribution"].toArray(), atol=0.02)
    unknown = spark.createDataFrame([(1, "nothing", 2)], "review_id long, term string, tf long")
    assert model.distributions(unknown, "review_id").first()["vec"] == [0.5, 0.5]
    model.save(str(tmp_path / "topics"))
    kept = topics.TopicModel.load(spark, str(tmp_path / "topics"))
    again = {r["review_id"]: r["vec"] for r in kept.distributions(counts, "review_id").collect()}
    assert all(np.allclose(again[n], shares[n]) for n in shares)


def test_shares_equal_a_plain_loop():
    rng = np.random.default_rng(5)
    weights, alpha = topics.topic_weights(rng.gamma(2.0, 1.0, (9, 3))), np.array([0.3, 0.2, 0.5])
    bounds, terms, tf = np.array([0, 4, 4, 7]), np.array([0, 3, 5, 8, 1, 2, 3]), np.array([1.0, 2, 1, 3, 2, 2, 1])
    got = topics.topic_shares(weights, alpha, terms, tf, bounds)
    for d in range(3):
        own, n = terms[bounds[d] : bounds[d + 1]], tf[bounds[d] : bounds[d + 1]]
        gamma = alpha + n.sum() / 3
        for _ in range(500 if len(own) else 0):
            theta = np.exp(topics.digamma(gamma) - topics.digamma(gamma.sum()))
            gamma = alpha + sum(c * theta * weights[t] / (theta @ weights[t]) for t, c in zip(own, n, strict=True))
        assert np.allclose(got[d], gamma / gamma.sum() if len(own) else 1 / 3, atol=5e-3)
    x = np.array([0.1, 0.5, 1.0, 3.7, 50.0])
    step = 1e-5
    assert np.allclose(topics.digamma(x), [(math.lgamma(v + step) - math.lgamma(v - step)) / (2 * step) for v in x], atol=1e-7)


def test_sweep_shares_one_vocabulary(spark, monkeypatch):
    fitted = []
    real = topics.bags_of
    monkeypatch.setattr(topics, "bags_of", lambda *a, **k: fitted.append(1) or real(*a, **k))
    reviews = reviews_of_two_things(spark)
    got = topics.coherence_sweep(reviews, topics.term_counts(reviews, "review_id"), "review_id", (2, 3, 4), passes=1, min_docs=1)
    assert {r["n_topics"] for r in got.collect()} == {2, 3, 4} and fitted == [1]


def test_ledger(spark, tmp_path):
    lines = [
        '{"reviewerID": "A", "asin": "1", "overall": 5.0, "reviewText": "fine", "reviewTime": "07 9, 2012"}',
        '{"reviewerID": "B", "asin": "1", "overall": 4.0, "reviewText": "", "reviewTime": "someday"}',
        '{"reviewerID": "B", "asin": "2", "overall": 4.0, "reviewText": "x"}',
        '{"reviewerID": "C", "asin": "3", "overall": 4.0, "reviewText": "x", "reviewTime": "07 10, 2012"}',
        "broken",
    ]
    (tmp_path / "r.json").write_text("\n".join(lines))
    ledger = accounting.Ledger()
    reviews, rejects = accounting.read_reviews(spark, str(tmp_path / "r.json"), ledger)
    meta = spark.createDataFrame([("1", "t"), ("2", "getTime()"), ("3", "u"), ("4", None)], "item_id string, title string")
    kept = accounting.prepare(reviews, meta, ["title", "review_text"], ledger)
    assert sorted((r["user_id"], str(r["review_date"])) for r in kept.collect()) == [("A", "2012-07-09"), ("C", "2012-07-10")]
    assert [r["line"] for r in rejects.collect()] == ["broken"]
    assert ledger.counts() == {
        "reviews": {"rows": 4, "dates_not_parsed": 1}, "rejected lines": {"rows": 1}, "items": {"rows": 4, "broken_title": 1},
        "joined": {"rows": 3, "no_title": 0, "no_review_text": 1}, "kept": {"rows": 2},
    }
    assert ledger.table(spark).count() == 9
    with pytest.raises(ValueError, match="noted already"):
        ledger.note(meta, "items")


def test_small_parts(spark, tmp_path):
    cats = spark.createDataFrame([('[["A", "B"], ["C"]]',), ("[]",), (None,)], "t string")
    assert [r["x"] for r in cats.select(readers.nested_category(F.col("t")).alias("x")).collect()] == ["B", None, None]
    metrics = spark.createDataFrame([("Pets", 1), ("Food", 2)], "Category string, N int")
    assert [r["N"] for r in serve.metrics_of(metrics, "Pets").collect()] == [1]
    pairs = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [round(r["x"], 6) for r in pairs.select(cosine(F.col("a"), F.col("b")).alias("x")).collect()] == [0.707107, 0.0]
    (tmp_path / "r.json").write_text('{"reviewerID": "A", "asin": "1"}')
    (tmp_path / "m.json").write_text('{"asin": "1", "title": "t"}')
    assert readers.load_dataset(spark, str(tmp_path / "r.json")).count() == 1
    assert [d.count() for d in readers.load_dataset(spark, str(tmp_path / "r.json"), str(tmp_path / "m.json"))] == [1, 1]
    spark.sql("DROP TABLE IF EXISTS appended")
    for n in (1, 2):
        spark.createDataFrame([("x", n)], "category string, v int").write.option("path", str(tmp_path / "t")).mode("append").saveAsTable("appended") if n == 1 else writers.append_table(spark.createDataFrame([("x", n)], "category string, v int"), "appended")
    assert sorted(r["v"] for r in spark.table("appended").collect()) == [1, 2]
