"""What iterations leave on disk: shuffle files and tables of rounds that nothing reads any more."""

import os
import time

from pyspark.sql import functions as F

from reviewloom.operators import als, factorise, paragraph
from reviewloom.session import checkpoint_dir, discard, durable


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {os.path.basename(f) for f in files if os.path.basename(f).startswith("shuffle_")}


def _tables(spark):
    folder = checkpoint_dir(spark).removeprefix("file:") + "/tables"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def _ratings(spark):
    rows = [(u * 10 + i, u, i, float(1 + (u * i) % 5)) for u in range(12) for i in range(8) if (u + i) % 3]
    return spark.createDataFrame(rows, "review_id long, user_id long, item_id long, rating double")


def test_shuffle_files_go_once_the_table_is_written(spark):
    before = _shuffle_files(spark)
    table = durable(spark.range(5_000).repartition(7, "id").groupBy((F.col("id") % 9).alias("k")).count())
    for _ in range(100):
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    assert sorted(r["count"] for r in table.collect())[0] == 555


def test_discarded_table_is_gone_and_others_stay(spark):
    first, second = durable(spark.range(3)), durable(spark.range(4))
    before = _tables(spark)
    discard(first, spark.range(5))  # what is no table of its own is left alone
    assert len(before) - len(_tables(spark)) == 1
    assert second.count() == 4


def test_least_squares_keeps_only_its_last_factors(spark):
    train = _ratings(spark)
    before = _tables(spark)
    model = als.fit(train, factors=3, epochs=4, blocks=2)
    assert len(_tables(spark) - before) == 2
    assert model.users.count() == 12 and model.items.count() == 8


def test_least_squares_with_cut_rows_keeps_only_its_last_factors(spark, monkeypatch):
    train = _ratings(spark)
    whole = {r["user_id"]: r["vec"] for r in als.fit(train, factors=3, epochs=2, blocks=2).users.collect()}
    monkeypatch.setattr(als, "MOST_RATINGS", 2)
    before = _tables(spark)
    cut = {r["user_id"]: r["vec"] for r in als.fit(train, factors=3, epochs=2, blocks=2).users.collect()}
    assert len(_tables(spark) - before) == 2
    assert all(abs(a - b) < 1e-8 for u in whole for a, b in zip(whole[u], cut[u], strict=True))


def test_gradient_descent_keeps_only_its_last_factors(spark):
    train = _ratings(spark)
    starts = [factorise.random_start(train, key, 3, 1) for key in ("user_id", "item_id")]
    before = _tables(spark)
    model = factorise.fit(train, *starts, epochs=3, blocks=2)
    assert len(_tables(spark) - before) == 1
    assert model.users.count() == 12 and model.items.count() == 8


def test_review_vectors_keep_their_last_vectors_and_hand_on_no_words(spark):
    rows = [(i, i % 4, f"alpha beta w{i % 7} gamma w{i % 3} delta") for i in range(60)]
    docs = paragraph.tagged_documents(
        spark.createDataFrame(rows, "review_id long, item_id long, processed_text string"), ("item",)
    )
    whole = paragraph.train(docs, dim=6, epochs=3, parts=2)
    before = _tables(spark)
    few = paragraph.train(docs, dim=6, epochs=3, parts=2, keep_words=False)
    assert len(_tables(spark) - before) == 2  # vectors, and counts of words
    assert few.words is None and whole.words.count() == 11
    a, b = ({r["tag"]: r["vec"] for r in m.tags.collect()} for m in (whole, few))
    assert a.keys() == b.keys() == {"0", "1", "2", "3"}
    assert all(len(a[k]) == 6 and max(abs(x - y) for x, y in zip(a[k], b[k], strict=True)) < 1e-5 for k in a)
