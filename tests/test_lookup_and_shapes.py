"""Stored lookup tables, exact quantiles, numbering and reshaping."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.operators import explore, numbering, quantiles, reshape, serve, topics
from reviewloom.sources import lookup

RECS = "user_id long, item_rank int, item_id long, algorithm string, title string"


def lists(spark, algorithm, users=400, score=0):
    rows = [(u, r, (u * 7 + r + score) % 90, algorithm, f"t{r}") for u in range(users) for r in range(5)]
    return spark.createDataFrame(rows, RECS)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def files_read(spark, df):
    """Number of files that the tasks of the plan's only scan open."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
        return sum(len(part.files()) for part in leaf.inputRDD().partitions())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_lookup_table(spark, tmp_path):
    name, path = "lookup_test", str(tmp_path / "recs")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    serve.store_recommendations(lists(spark, "ER-CBF"), name, path, buckets=8)
    serve.store_recommendations(lists(spark, "RANDOM"), name)
    assert spark.table(name).count() == 4_000
    # storing an algorithm again replaces its lists, and those of no other
    stored = serve.store_recommendations(lists(spark, "ER-CBF", users=300, score=1), name)
    assert {r["algorithm"]: r["count"] for r in stored.groupBy("algorithm").count().collect()} == {"ER-CBF": 1_500, "RANDOM": 2_000}
    got = serve.top_n(spark, name, 17, "er-cbf", 3)
    assert [(r["item_rank"], r["item_id"]) for r in got.collect()] == [(r, (17 * 7 + r + 1) % 90) for r in range(3)]
    assert set(got.columns) == {"user_id", "item_rank", "item_id", "algorithm", "title"}
    plan = plan_of(got)
    assert "PartitionFilters: [isnotnull(algorithm" in plan
    assert "EqualTo(user_id,17)" in plan and "Python" not in plan and "Arrow" not in plan
    assert files_read(spark, serve.top_n(spark, name, 17, "er-cbf", 3)) == 1
    assert files_read(spark, spark.table(name)) == 16
    assert "Exchange" not in plan_of(serve.list_users(spark.table(name).where("algorithm = 'RANDOM'")))
    assert serve.list_users(stored).count() == 400
    assert serve.top_n(spark, name, 10**9, "er-cbf", 3).count() == 0
    assert serve.top_n(spark, name, 17, "x' OR '1'='1", 3).count() == 0


def test_lookup_table_edges(spark, tmp_path):
    for name in ("lookup_history", "lookup_empty"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    rows = [("u", "i", None), ("u", "i", None), (None, "j", "t"), ("v", None, "t")]
    train = spark.createDataFrame(rows, "user_id string, item_id string, title string")
    for _ in range(2):  # a table without columns to replace by is replaced as a whole
        serve.store_history(train, "lookup_history", str(tmp_path / "h"), buckets=2)
    assert spark.table("lookup_history").count() == 4
    assert sorted(map(repr, serve.history(spark, "lookup_history", "u").collect())) == ["Row(item_id='i', title=None)"] * 2
    serve.store_history(train.where("false"), "lookup_empty", str(tmp_path / "e"))
    assert serve.history(spark, "lookup_empty", "u").count() == 0
    with pytest.raises(ValueError, match="has the columns"):
        lookup.store(train.withColumn("x", F.lit(1)), "lookup_history", "user_id")
    assert lookup.buckets_for(1) == 8 and lookup.buckets_for(10**8) == 100


def test_demo_extract_is_read_back(spark, tmp_path):
    for name in ("lookup_all", "lookup_demo"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    stored = serve.store_recommendations(lists(spark, "ER-CBF"), "lookup_all", str(tmp_path / "a"))
    demo = serve.store_recommendations(serve.demo_extract(stored, 10, pinned=(3, 5)), "lookup_demo", str(tmp_path / "d"))
    users = {r["user_id"] for r in demo.collect()}
    assert {3, 5} <= users and 10 <= len(users) <= 12 and demo.count() == 5 * len(users)


def test_quantiles_are_exact(spark, monkeypatch):
    rng = random.Random(4)
    series = {
        "whole": [rng.randrange(50) for _ in range(5_000)],
        "one": [3.5],
        "equal": [2.0] * 100,
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(800)],
        "close": [1.0 + k * 2**-52 for k in range(200)],
        "tiny": [0.0, 5e-324, 5e-324, 1e-323],
        "huge": [-1.7e308, 1.7e308, 0.0, 5.0],
    }
    rows = [(k, float(v)) for k, vs in series.items() for v in vs] + [("whole", None), ("none", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "series string, value double").repartition(7)
    wanted = (0.0, 0.25, 0.5, 0.8, 1.0)
    got = quantiles.quantiles(df, wanted)
    for name, values in series.items():
        want = [float(np.quantile(np.array(values), p)) if name != "huge" else None for p in wanted]
        for a, b in zip(got[name], want, strict=True):
            assert b is None or a == b or math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-320), name
    assert got["huge"][0] == -1.7e308 and got["huge"][-1] == 1.7e308
    assert got["none"] == [None] * 5
    monkeypatch.setattr(quantiles, "BINS", 3)  # many passes
    assert quantiles.quantiles(df.where("series = 'whole'"), wanted)["whole"] == got["whole"]
    assert quantiles.quantiles(df.where("false"), wanted) == {}
    with pytest.raises(ValueError, match="not finite"):
        quantiles.quantiles(spark.createDataFrame([("x", math.inf), ("x", 1.0)], "series string, value double"), wanted)


def test_spread_of_empty_and_single_groups(spark):
    df = spark.createDataFrame([(1, "a", "u", 4.0), (2, "a", None, 2.0), (3, None, "u", None)], "review_id long, item_id string, user_id string, rating double")
    got = {r["grouped_by"]: r for r in explore.review_count_stats(df).collect()}
    assert (got["item_id"]["min_value"], got["item_id"]["max_value"], got["item_id"]["q50"]) == (1.0, 2.0, 1.5)
    assert (got["user_id"]["min_value"], got["user_id"]["q25"], got["user_id"]["global_avg"]) == (1.0, 1.25, 3.0)
    means = {r["grouped_by"]: r for r in explore.rating_stats(df).collect()}
    assert means["item_id"]["q75"] == 3.0 and means["user_id"]["avg_value"] == 3.0
    assert explore.review_count_stats(df.where("false")).count() == 0


def test_no_aggregate_keeps_distinct_values(spark):
    df = spark.createDataFrame([(i, i % 7, i % 5, 1.0 * (i % 4)) for i in range(60)], "review_id long, item_id long, user_id long, rating double")
    plans = [
        plan_of(x) for x in (
            explore.review_count_stats(df), explore.rating_stats(df), explore.weighted_ratings(explore.mean_ratings(df)),
            explore.long_tail(df), explore.token_stats(df.select(F.array("item_id").alias("tokens"))), explore.describe(df),
        )
    ]
    assert not any("percentile" in p or "ObjectHashAggregate" in p or "SinglePartition" in p.replace("Exchange SinglePartition, ENSURE_REQUIREMENTS", "") for p in plans)


def test_numbering(spark):
    rng = random.Random(1)
    keys = rng.sample(range(10**6), 3_000)
    df = spark.createDataFrame([(k,) for k in keys + keys[:50]] + [(None,)], "user_id long").repartition(9)
    got = {r["user_id"]: r["index"] for r in numbering.dense_index(df, "user_id").collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}
    assert "SinglePartition" not in plan_of(numbering.dense_index(df, "user_id"))
    rows = spark.createDataFrame([(i // 3, i) for i in range(1, 40)], "k int, v long").repartition(5)
    got = {r["v"]: r["upto"] for r in numbering.running_total(rows, "v", "upto", F.desc("k")).collect()}
    assert got == {i: sum(j for j in range(1, 40) if j // 3 >= i // 3) for i in range(1, 40)}
    assert numbering.dense_index(df.where("false"), "user_id").count() == 0


def test_wide_to_long(spark):
    wide = spark.createDataFrame([(1, [5, 6, 7], [8]), (2, [], None), (3, [None, 4], [2])], "user_id int, liked array<int>, others array<int>")
    got = sorted(map(repr, map(tuple, reshape.lists_to_long(wide, ["user_id"], ["liked", "others"], "list", "place", "item").collect())))
    assert got == sorted(map(repr, [
        (1, "liked", 0, 5), (1, "liked", 1, 6), (1, "liked", 2, 7), (1, "others", 0, 8), (3, "liked", 0, None), (3, "liked", 1, 4), (3, "others", 0, 2),
    ]))
    plain = reshape.wide_to_long(spark.createDataFrame([(1, 2, 3)], "id int, a int, b int"), ["id"], ["a", "b"])
    assert sorted(map(tuple, plain.collect())) == [(1, "a", 2), (1, "b", 3)]


@pytest.mark.parametrize("limit", [1, 40, 1 << 20])
def test_texts_in_order(spark, limit):
    rng = random.Random(6)
    rows = [(i, rng.choice(["u", "u", "u", "v", f"w{i % 7}"]), i % 11, " ".join(rng.choice("abcde") * 4 for _ in range(rng.randrange(1, 9)))) for i in range(500)]
    rows += [(900, "u", 3, None), (901, None, 3, "x"), (902, "empty", 1, ""), (903, "empty", 1, "")]
    df = spark.createDataFrame(rows, "review_id long, user_id string, day int, text string").repartition(6)
    pieces = reshape.text_pieces(df, "user_id", "text", ["day", "review_id"], limit=limit)
    want = {}
    for i, u, d, t in sorted((r for r in rows if r[1] is not None and r[3] is not None), key=lambda r: (r[1], r[2], r[0])):
        want.setdefault(u, []).append(t)
    found = pieces.collect()
    for u, texts in want.items():
        own = sorted((r for r in found if r["user_id"] == u), key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert " ".join(r["text"] for r in own) == " ".join(texts)
        assert all(len(r["text"]) <= limit or r["n_texts"] == 1 for r in own)
    assert {r["user_id"]: r["text"] for r in reshape.whole_texts(pieces, "user_id").collect()} == {u: " ".join(t) for u, t in want.items()}
    # counts of terms in the texts put together are the sums of the counts in each
    kept = df.where("user_id is not null and text != ''").select("review_id", "user_id", F.col("text").alias("processed_text"))
    summed = topics.term_counts(kept, "review_id").join(kept.select("review_id", "user_id"), "review_id").groupBy("user_id", "term").agg(F.sum("tf").alias("tf"))
    whole = reshape.whole_texts(reshape.text_pieces(kept, "user_id", "processed_text", ["review_id"], limit=limit), "user_id")
    counted = topics.term_counts(whole.select("user_id", F.col("text").alias("processed_text")), "user_id")
    assert sorted(map(tuple, summed.select("user_id", "term", "tf").collect())) == sorted(map(tuple, counted.select("user_id", "term", "tf").collect()))
