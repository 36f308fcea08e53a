"""Fixed schemas of the raw files and of the tables between stages."""

from pyspark.sql import types as T

# Field names of the public review and product dumps.
RAW_REVIEW_FIELDS = {
    "reviewerID": "user_id",
    "asin": "item_id",
    "overall": "rating",
    "reviewText": "review_text",
    "reviewTime": "review_time",
}
RAW_META_FIELDS = {"asin": "item_id", "title": "title", "categories": "categories"}

REJECT = "_corrupt_record"

RAW_REVIEWS = T.StructType(
    [
        T.StructField("reviewerID", T.StringType()),
        T.StructField("asin", T.StringType()),
        T.StructField("overall", T.DoubleType()),
        T.StructField("reviewText", T.StringType()),
        T.StructField("reviewTime", T.StringType()),
        T.StructField(REJECT, T.StringType()),
    ]
)

# `categories` is kept as text by the reader: dumps hold it flat or nested.
RAW_META = T.StructType(
    [
        T.StructField("asin", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("categories", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField(REJECT, T.StringType()),
    ]
)

REVIEWS = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("item_id", T.StringType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("review_text", T.StringType()),
        T.StructField("review_time", T.StringType()),
    ]
)

META = T.StructType(
    [
        T.StructField("item_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("categories", T.ArrayType(T.StringType())),
    ]
)

RECOMMENDATIONS = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("item_rank", T.IntegerType()),
        T.StructField("item_id", T.StringType()),
        T.StructField("algorithm", T.StringType()),
        T.StructField("title", T.StringType()),
    ]
)

METRICS = T.StructType(
    [
        T.StructField("Category", T.StringType()),
        T.StructField("Algorithm", T.StringType()),
        T.StructField("N", T.IntegerType()),
        T.StructField("Recall@N", T.DoubleType()),
        T.StructField("Novelty@N", T.DoubleType()),
    ]
)

# Rating scale, names of the recommenders, list lengths of the experiments.
RATING_MIN, RATING_MAX = 1.0, 5.0
LIST_LENGTHS = (5, 10, 15, 20)
SPLIT_RATIO = 0.7
COLD_START_MAX = 2
