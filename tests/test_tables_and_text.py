import json

from pyspark.sql import functions as F

from reviewloom.functions import text as X
from reviewloom.functions.scalar import review_date
from reviewloom.operators import clean
from reviewloom.sources import readers, writers


def one(spark, col, value):
    return spark.createDataFrame([(value,)], "t string").select(col(F.col("t")).alias("x")).first()["x"]


def test_preprocess(spark):
    def run(value):
        return one(spark, X.preprocess, value)

    assert run("It's\nGREAT, 100% café!") == "great caf"
    assert run("") == ""
    assert run("12345 67") == ""
    assert run("abcdefghijklmnop short") == "short"
    assert one(spark, X.normalise, "I don't and can’t; she'd") == "i do not and cannot she would"


def test_stop_words_are_sparks_own(spark):
    from pyspark.ml.feature import StopWordsRemover

    singles = [w for w in StopWordsRemover.loadDefaultStopWords("english") if "'" not in w]
    assert sorted(singles) == sorted(X.STOP_WORDS)


def test_lemmas_keep_order(spark):
    lemmas = spark.createDataFrame([("cats", "cat"), ("ran", "run")], "form string, lemma string")
    docs = spark.createDataFrame([(1, "Cats ran home, cats!"), (2, "nothing here")], "review_id int, review_text string")
    out = {r["review_id"]: r["processed_text"] for r in X.preprocess_reviews(docs, lemmas=lemmas).collect()}
    assert out == {1: "cat run home cat", 2: "nothing"}


def test_dates(spark):
    rows = [("07 9, 2012",), ("07 19, 2012",), ("7 9, 2012",), ("bad",)]
    got = spark.createDataFrame(rows, "t string").select(review_date(F.col("t")).alias("d")).collect()
    assert [str(r["d"]) for r in got] == ["2012-07-09", "2012-07-19", "2012-07-09", "None"]


def test_merge_rules(spark):
    meta = spark.createDataFrame(
        [("1", None), ("2", "var getTime()"), ("3", ""), ("4", "good"), ("4", "good again"), ("5", " ")],
        "item_id string, title string",
    )
    reviews = spark.createDataFrame([(str(i), "u", "text") for i in range(1, 6)], "item_id string, user_id string, review_text string")
    got = sorted((r["item_id"], r["title"]) for r in clean.merge_reviews(reviews, meta).collect())
    assert got == [("4", "good"), ("4", "good again"), ("5", " ")]
    assert clean.merge_reviews(reviews, meta, dedupe_meta=True).count() == 2


def test_raw_records(spark, tmp_path):
    lines = [
        '{"reviewerID": "A", "asin": "007", "overall": 5.0, "reviewText": "fine", "reviewTime": "07 9, 2012"}',
        "{'reviewerID': 'B', 'asin': '1', 'overall': 4, 'reviewText': 'it\\'s ok', 'reviewTime': '07 9, 2012'}",
        "{'reviewerID': 'C', 'asin': '2', 'overall': 3.0, 'reviewText': None, 'reviewTime': '07 9, 2012'}",
        "{'reviewerID': 'D', 'asin': '3', 'overall': 3.0, 'verified': True, 'reviewText': 'x', 'reviewTime': 'y'}",
        "{'reviewerID': 'E', 'asin': '4'}",
        "{'reviewerID': 'F', broken",
    ]
    path = tmp_path / "reviews.json"
    path.write_text("\n".join(lines))
    rows, rejects = readers.read_records(spark, str(path), readers.RAW_REVIEWS)
    got = {r["reviewerID"]: (r["asin"], r["overall"], r["reviewText"]) for r in rows.collect()}
    assert got == {
        "A": ("007", 5.0, "fine"), "B": ("1", 4.0, "it's ok"), "C": ("2", 3.0, None), "D": ("3", 3.0, "x"),
        "E": ("4", None, None),
    }
    assert [r["line"] for r in rejects.collect()] == [lines[-1]]
    meta = tmp_path / "meta.json"
    meta.write_text(
        json.dumps({"asin": "1", "title": "t", "categories": [["P", "Q"], ["R"]]}) + "\n"
        + "{'asin': '2', 'title': 'u', 'category': ['P', 'S']}"
    )
    got = {r["item_id"]: r["categories"] for r in readers.read_meta(spark, str(meta)).collect()}
    assert got == {"1": ["P", "Q", "R"], "2": ["P", "S"]}


def test_csv_and_metrics(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text('user_id,item_id,rating,review_text,review_time\nA,007,4.0,"line\nwith ""quotes""",x\nB,NA,1,null,y\n')
    got = {r["user_id"]: r["review_text"] for r in readers.read_csv(spark, str(path)).collect()}
    assert got == {"A": 'line\nwith "quotes"', "B": "null"}
    metrics = tmp_path / "m.csv"
    metrics.write_bytes("﻿Category,Algorithm,N,Recall@N,Novelty@N\nPets,UB-CF,5,0.1,0.9\n".encode())
    assert readers.read_metrics(spark, str(metrics)).first()["Category"] == "Pets"


def test_stage_tables(spark, tmp_path):
    path = str(tmp_path / "stage")
    a = spark.createDataFrame([("x", 1), ("y", 2)], "category string, v int")
    writers.write_stage(a, path)
    writers.write_stage(spark.createDataFrame([("y", 3)], "category string, v int"), path)
    assert sorted((r["category"], r["v"]) for r in readers.read_stage(spark, path).collect()) == [("x", 1), ("y", 3)]
    assert readers.read_stage(spark, path, "x").count() == 1
    recs = spark.createDataFrame([("u", 0, "i", "ER-CBF", "t", "x")], "user_id string, item_rank int, item_id string, algorithm string, title string, category string")
    for _ in range(2):  # a second run replaces the lists
        writers.write_recommendations(recs, str(tmp_path / "recs"))
    assert spark.read.parquet(str(tmp_path / "recs")).count() == 1
