"""Reviews, items and item vectors read from the star-schema tables.

Every order line is one review: the customer is the user, the part is the item, the quantity gives
the rating, and a document chosen by the keys of the line is the review text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def reviews(spark: SparkSession, root: str) -> DataFrame:
    """(review_id, user_id, item_id, rating, review_date, doc_id), one row per order line."""
    n_docs = table(spark, root, "documents").count()  # from the file footers
    lines = table(spark, root, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate"
    )
    orders = table(spark, root, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        (
            ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 10000
            + F.col("l_suppkey")
        ).alias("review_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        (1 + F.floor("l_quantity") % 5).cast("double").alias("rating"),
        F.to_date("l_shipdate").alias("review_date"),
        ((F.col("l_orderkey") * 31 + F.col("l_linenumber") * 7 + F.col("l_partkey")) % n_docs).alias("doc_id"),
    )


def texts(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, review_text, lang)."""
    return table(spark, root, "documents").select("doc_id", F.col("text").alias("review_text"), "lang")


def review_texts(spark: SparkSession, root: str) -> DataFrame:
    """Reviews with their text."""
    return reviews(spark, root).join(texts(spark, root), "doc_id")


def items(spark: SparkSession, root: str) -> DataFrame:
    """(item_id, title, brand, category)."""
    return table(spark, root, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
    )


def _vectors(spark: SparkSession, root: str, ids: DataFrame, key: str) -> DataFrame:
    emb = table(spark, root, "embeddings")
    n = emb.count()
    vecs = emb.select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    return ids.join(vecs, (F.col(key) % n) == F.col("vec_id")).select(key, "vec")


def item_vectors(spark: SparkSession, root: str) -> DataFrame:
    """(item_id, vec): 64 doubles; items whose ids agree modulo the number of vectors share one."""
    return _vectors(spark, root, items(spark, root).select("item_id"), "item_id")


def user_vectors(spark: SparkSession, root: str) -> DataFrame:
    """(user_id, vec) for every customer, from the same vectors."""
    ids = table(spark, root, "customer").select(F.col("c_custkey").alias("user_id"))
    return _vectors(spark, root, ids, "user_id")
