"""Named queries over the star-schema tables: (spark, folder) -> DataFrame. Each one reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions.scalar import rounded, vector_scale
from reviewloom.functions.text import final_tokens, normalise, preprocess_reviews, words
from reviewloom.operators import (
    accounting,
    baseline,
    clean,
    content,
    evaluate,
    explore,
    factorise,
    index,
    neighbours,
    numbering,
    paragraph,
    recommend,
    reshape,
    serve,
    split,
    topics,
)
from reviewloom.session import durable
from reviewloom.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters of the queries; the oracle uses the same ones.
USER, ITEM = 1, 3
SHARING = (0, 44)  # users who have items in common
PINNED = (5,)
LEMMAS = (
    ("des", "de"), ("les", "le"), ("los", "el"), ("las", "el"), ("der", "die"), ("das", "die"),
    ("was", "be"), ("worthless", "worth"),
)
FACTOR_SCALE = 0.2
TOPIC_SWEEP = tuple(range(5, 50, 5))
VECTOR_EPOCHS = 2  # of the named queries that learn review vectors; the operator's default is 10, figures of both in the README


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def train_of(spark: SparkSession, root: str) -> DataFrame:
    return split.split_train_test(tables.reviews(spark, root))[0]


def with_titles(reviews: DataFrame, spark: SparkSession, root: str) -> DataFrame:
    return reviews.join(tables.items(spark, root).select("item_id", "title"), "item_id")


def processed_texts(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, processed_text). Reviews that share a text have it cleaned once."""
    docs = tables.texts(spark, root).select("doc_id", "review_text")
    return clean.drop_empty_texts(preprocess_reviews(docs)).drop("review_text")


def review_tokens(spark: SparkSession, root: str) -> DataFrame:
    """Train reviews with their cleaned text."""
    return train_of(spark, root).join(processed_texts(spark, root), "doc_id")


# --- tables, cleaning, overviews


@query
def reviews_view(spark: SparkSession, root: str) -> DataFrame:
    return tables.reviews(spark, root)


@query
def clean_merge(spark: SparkSession, root: str) -> DataFrame:
    merged = clean.merge_reviews(tables.review_texts(spark, root), tables.items(spark, root))
    return merged.select(
        "review_id", "item_id", "user_id", "title", "category", "rating", F.md5("review_text").alias("text_md5")
    )


@query
def sparsity(spark: SparkSession, root: str) -> DataFrame:
    return clean.sparsity(tables.review_texts(spark, root))


@query
def table_shape(spark: SparkSession, root: str) -> DataFrame:
    return clean.shape(tables.reviews(spark, root))


@query
def table_overview(spark: SparkSession, root: str) -> DataFrame:
    return clean.overview(tables.reviews(spark, root))


@query
def describe_reviews(spark: SparkSession, root: str) -> DataFrame:
    return explore.describe(tables.reviews(spark, root).select("user_id", "item_id", "rating"))


@query
def summary_stats(spark: SparkSession, root: str) -> DataFrame:
    return explore.distinct_counts(tables.reviews(spark, root), ["user_id", "item_id", "doc_id"])


@query
def value_counts_top10(spark: SparkSession, root: str) -> DataFrame:
    return explore.top_values(tables.reviews(spark, root), "item_id")


@query
def reviews_count_stats(spark: SparkSession, root: str) -> DataFrame:
    return explore.review_count_stats(tables.reviews(spark, root))


@query
def rating_stats(spark: SparkSession, root: str) -> DataFrame:
    return explore.rating_stats(tables.reviews(spark, root))


@query
def category_rating(spark: SparkSession, root: str) -> DataFrame:
    merged = tables.reviews(spark, root).join(tables.items(spark, root), "item_id")
    return explore.top_mean_rating(merged, "category")


@query
def category_reviews(spark: SparkSession, root: str) -> DataFrame:
    merged = tables.reviews(spark, root).join(tables.items(spark, root), "item_id")
    return explore.top_review_count(merged, "category")


def _weighted(spark: SparkSession, root: str, key: str) -> DataFrame:
    means = explore.weighted_ratings(explore.mean_ratings(tables.reviews(spark, root), key))
    return means.select(
        key, "rating_count", rounded(F.col("rating_avg")).alias("rating_avg"),
        rounded(F.col("rating_weighted")).alias("rating_weighted"),
    )


@query
def weighted_rating_items(spark: SparkSession, root: str) -> DataFrame:
    return _weighted(spark, root, "item_id")


@query
def weighted_rating_users(spark: SparkSession, root: str) -> DataFrame:
    return _weighted(spark, root, "user_id")


@query
def top25_items(spark: SparkSession, root: str) -> DataFrame:
    return explore.top_by(_weighted(spark, root, "item_id"), "rating_weighted", "item_id")


@query
def top25_reviewed_items(spark: SparkSession, root: str) -> DataFrame:
    return explore.top_by(_weighted(spark, root, "item_id"), "rating_count", "item_id")


# --- texts


@query
def text_stats(spark: SparkSession, root: str) -> DataFrame:
    return explore.text_stats(tables.texts(spark, root))


@query
def preprocess_text(spark: SparkSession, root: str) -> DataFrame:
    return processed_texts(spark, root)


@query
def preprocess_lemmas(spark: SparkSession, root: str) -> DataFrame:
    lemmas = spark.createDataFrame(list(LEMMAS), "form string, lemma string")
    docs = tables.texts(spark, root).select("doc_id", "review_text")
    out = preprocess_reviews(docs, key="doc_id", lemmas=lemmas)
    return clean.drop_empty_texts(out).select("doc_id", "processed_text")


@query
def token_stats(spark: SparkSession, root: str) -> DataFrame:
    tokens = final_tokens(F.split(normalise(F.col("review_text")), " "))
    return explore.token_stats(tables.texts(spark, root).select(tokens.alias("tokens")))


@query
def distinct_tokens(spark: SparkSession, root: str) -> DataFrame:
    raw = explore.distinct_tokens(tables.texts(spark, root), "review_text").withColumnRenamed("n_tokens", "n_raw")
    done = explore.distinct_tokens(processed_texts(spark, root), "processed_text")
    return raw.select("n_raw", done.select("n_tokens").scalar().alias("n_processed"))


@query
def length_slice(spark: SparkSession, root: str) -> DataFrame:
    docs = processed_texts(spark, root)
    return explore.length_slice(docs, "doc_id", "processed_text").select(
        "doc_id", F.length("processed_text").alias("n_chars")
    )


@query
def histogram_ratings(spark: SparkSession, root: str) -> DataFrame:
    means = explore.mean_ratings(tables.reviews(spark, root))
    return explore.histogram(means, F.col("rating_avg"), bins=25)


@query
def histogram_words(spark: SparkSession, root: str) -> DataFrame:
    return explore.histogram(tables.texts(spark, root), F.size(words(F.col("review_text"))), width=10)


@query
def long_tail(spark: SparkSession, root: str) -> DataFrame:
    return explore.long_tail(tables.reviews(spark, root))


@query
def sampled_reviews(spark: SparkSession, root: str) -> DataFrame:
    return explore.sample_rows(tables.reviews(spark, root), "review_id", 25).select("review_id", "user_id", "item_id")


# --- split


@query
def time_split_counts(spark: SparkSession, root: str) -> DataFrame:
    marked = split.mark_split(tables.reviews(spark, root))
    return marked.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_reviews"), F.sum(F.col("is_test").cast("bigint")).alias("n_test")
    )


@query
def time_split_train(spark: SparkSession, root: str) -> DataFrame:
    return train_of(spark, root).select("review_id", "user_id", "item_id", "rating", "review_date")


@query
def time_split_test(spark: SparkSession, root: str) -> DataFrame:
    test = split.split_train_test(tables.reviews(spark, root))[1]
    return test.select("review_id", "user_id", "item_id", "rating", "review_date")


@query
def cold_start_users(spark: SparkSession, root: str) -> DataFrame:
    return split.cold_start_users(train_of(spark, root), most=COLD_START)


@query
def cold_start_share(spark: SparkSession, root: str) -> DataFrame:
    return split.cold_start_share(train_of(spark, root), most=COLD_START)


@query
def item_popularity(spark: SparkSession, root: str) -> DataFrame:
    shares = evaluate.item_popularity(train_of(spark, root))
    return shares.select("item_id", "n_reviews", F.round("popularity", 6).alias("popularity"))


# The stand-in reviews hold few users with at most two train rows, so the queries draw the line higher.
COLD_START = 12


# --- recommenders


@query
def user_profile_vectors(spark: SparkSession, root: str) -> DataFrame:
    profiles = content.user_profiles(train_of(spark, root), tables.item_vectors(spark, root))
    return profiles.select("user_id", F.posexplode("vec").alias("pos", "v")).select(
        "user_id", "pos", rounded(F.col("v")).alias("value")
    )


@query
def knn_items(spark: SparkSession, root: str) -> DataFrame:
    vectors = tables.item_vectors(spark, root)
    return content.nearest_items(content.user_profiles(train_of(spark, root), vectors), vectors)


def ercbf(spark: SparkSession, root: str, n: int) -> DataFrame:
    return recommend.recommend("ER-CBF", train_of(spark, root), n, item_vectors=tables.item_vectors(spark, root))


@query
def ercbf_top10(spark: SparkSession, root: str) -> DataFrame:
    return ercbf(spark, root, 10)


@query
def ubcf_neighbours(spark: SparkSession, root: str) -> DataFrame:
    cells = durable(neighbours.deviations(train_of(spark, root)))
    return neighbours.nearest_users(cells)


@query
def ubcf_top10(spark: SparkSession, root: str) -> DataFrame:
    return recommend.recommend("UB-CF", train_of(spark, root), 10)


@query
def ubcf_pair(spark: SparkSession, root: str) -> DataFrame:
    """Predicted ratings of all test pairs."""
    train, test = split.split_train_test(tables.reviews(spark, root))
    return neighbours.predicted_ratings(train, test.select("user_id", "item_id").distinct())


@query
def mf_score_top10(spark: SparkSession, root: str) -> DataFrame:
    """Scoring and ranking alone, on factors taken from the embeddings and biases from the ratings."""
    train = durable(train_of(spark, root))
    mean = train.agg(F.avg("rating").alias("m")).first()["m"]

    def factors(vectors: DataFrame, key: str) -> DataFrame:
        bias = train.groupBy(key).agg((F.avg("rating") - F.lit(mean)).alias("bias"))
        return bias.join(vectors, key).withColumn("vec", vector_scale(F.col("vec"), F.lit(FACTOR_SCALE)))

    users = factors(tables.user_vectors(spark, root), "user_id")
    items = factors(tables.item_vectors(spark, root), "item_id")
    return factorise.score_lists(users, items, mean, 10, train)


@query
def mf_funk_top10(spark: SparkSession, root: str) -> DataFrame:
    return recommend.recommend("FUNK-SVD", durable(train_of(spark, root)), 10)


@query
def mf_topic_top10(spark: SparkSession, root: str) -> DataFrame:
    docs = durable(processed_texts(spark, root))
    train = durable(train_of(spark, root))
    users, items = topic_starts(topics.train_topics(docs), train, docs)
    return recommend.recommend("TI-MF", train, 10, user_vectors=users, item_vectors=items)


def topic_starts(model: topics.TopicModel, train: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Topic shares of users and items; texts are counted once."""
    counts = durable(topics.term_counts(docs, "doc_id"))
    return tuple(topic_start(model, train, counts, key) for key in ("user_id", "item_id"))


def topic_start(model: topics.TopicModel, train: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """Topic shares of users or items; the counts of their texts are added up per key."""
    times = train.groupBy(key, "doc_id").agg(F.count(F.lit(1)).alias("times"))
    summed = times.join(counts, "doc_id").groupBy(key, "term").agg(F.sum(F.col("tf") * F.col("times")).alias("tf"))
    return model.distributions(summed, key)


@query
def mf_vector_top10(spark: SparkSession, root: str) -> DataFrame:
    train = durable(train_of(spark, root))
    vectors = paragraph.review_vectors(train.join(processed_texts(spark, root), "doc_id"), kinds=("item", "user"), epochs=VECTOR_EPOCHS)
    return recommend.recommend(
        "MOD-ECF", train, 10,
        user_vectors=paragraph.vectors_of(vectors, "user", "bigint"), item_vectors=paragraph.vectors_of(vectors, "item", "bigint"),
    )


@query
def random_top10(spark: SparkSession, root: str) -> DataFrame:
    return recommend.recommend("RANDOM", durable(train_of(spark, root)), 10)


@query
def rating_moments(spark: SparkSession, root: str) -> DataFrame:
    moments = baseline.rating_moments(train_of(spark, root))
    return moments.select(F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


# --- bag of words and topics


@query
def bow_counts(spark: SparkSession, root: str) -> DataFrame:
    return topics.term_counts(durable(processed_texts(spark, root)), "doc_id")


@query
def dictionary_filter(spark: SparkSession, root: str) -> DataFrame:
    docs = durable(processed_texts(spark, root))
    frequencies = topics.document_frequencies(topics.term_counts(docs, "doc_id"))
    return topics.dictionary(frequencies, topics.number_of(docs))


@query
def tfidf(spark: SparkSession, root: str) -> DataFrame:
    docs = durable(processed_texts(spark, root))
    weights = topics.tfidf(topics.term_counts(docs, "doc_id"), "doc_id", topics.number_of(docs))
    return weights.select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query
def lda_user_topics(spark: SparkSession, root: str) -> DataFrame:
    docs = durable(processed_texts(spark, root))
    train = durable(train_of(spark, root))
    users = topic_start(topics.train_topics(docs), train, topics.term_counts(docs, "doc_id"), "user_id")
    return users.select("user_id", F.posexplode("vec").alias("topic", "share"))


@query
def lda_top_terms(spark: SparkSession, root: str) -> DataFrame:
    return topics.train_topics(processed_texts(spark, root)).top_terms(spark)


@query
def lda_coherence(spark: SparkSession, root: str) -> DataFrame:
    docs = durable(processed_texts(spark, root))
    counts = durable(topics.term_counts(docs, "doc_id"))
    top = durable(topics.train_topics(docs).top_terms(spark, topics.COHERENCE_TERMS))
    return topics.coherence(top, counts, "doc_id", topics.number_of(docs))


@query
def term_coherence(spark: SparkSession, root: str) -> DataFrame:
    """The coherence formula on one fixed set of terms per language: its most frequent ones."""
    docs = durable(processed_texts(spark, root))
    by_doc = topics.term_counts(docs, "doc_id")
    counts = durable(by_doc)
    langs = tables.texts(spark, root).select("doc_id", "lang")
    # terms of a document are together already, so only languages are shuffled
    by_lang = by_doc.join(langs.hint("shuffle_hash"), "doc_id").groupBy("lang", "term").agg(F.count(F.lit(1)).alias("df"))
    top = explore.best_per_group(by_lang, "lang", "df", "term", 10)
    top = top.select(F.col("lang").alias("topic"), "place", "term")
    scores = topics.coherence(top, counts, "doc_id", topics.number_of(docs))
    return scores.select(F.col("topic").alias("lang"), rounded(F.col("coherence")).alias("coherence"))


@query
def lda_sweep(spark: SparkSession, root: str) -> DataFrame:
    docs = durable(processed_texts(spark, root))
    return topics.coherence_sweep(docs, topics.term_counts(docs, "doc_id"), "doc_id", TOPIC_SWEEP)


# --- review vectors


@query
def paragraph_vectors(spark: SparkSession, root: str) -> DataFrame:
    vectors = paragraph.review_vectors(review_tokens(spark, root), kinds=("item",), epochs=VECTOR_EPOCHS)
    return vectors.select("kind", "tag", F.posexplode("vec").alias("pos", "value"))


@query
def similar_items(spark: SparkSession, root: str) -> DataFrame:
    """Items nearest to the text of all reviews of one item, with titles."""
    reviews = durable(with_titles(review_tokens(spark, root), spark, root))
    return paragraph.similar_items(reviews, ITEM, epochs=VECTOR_EPOCHS)


# --- evaluation


def _evaluated(spark: SparkSession, root: str, n: int = 20) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    train, test = split.split_train_test(tables.reviews(spark, root))
    train, test = durable(train), durable(test)
    lists = recommend.recommend("ER-CBF", train, n, item_vectors=tables.item_vectors(spark, root))
    return train, test, lists, evaluate.item_popularity(train)


@query
def recall_novelty_at_n(spark: SparkSession, root: str) -> DataFrame:
    _, test, lists, popularity = _evaluated(spark, root)
    return evaluate.evaluate(lists, test, popularity).select("n", "n_users", "recall", "novelty")


@query
def precision_at_n(spark: SparkSession, root: str) -> DataFrame:
    _, test, lists, popularity = _evaluated(spark, root, 45)
    scores = evaluate.evaluate(lists, test, popularity, (10, 25, 30, 45))
    return scores.select("n", "n_users", "precision")


@query
def cold_start_eval(spark: SparkSession, root: str) -> DataFrame:
    train, test, lists, popularity = _evaluated(spark, root)
    cold = split.cold_start_users(train, most=COLD_START)
    return evaluate.evaluate(lists, test, popularity, users=cold).select("n", "n_users", "recall", "novelty")


@query
def hit_users(spark: SparkSession, root: str) -> DataFrame:
    _, test, lists, popularity = _evaluated(spark, root)
    hits = evaluate.users_with_hits(evaluate.per_user_metrics(lists, test, popularity, (20,)))
    return hits.select("user_id", F.col("hits").cast("bigint").alias("hits"), F.round("recall", 6).alias("recall"))


@query
def metric_pivot(spark: SparkSession, root: str) -> DataFrame:
    train, test, lists, popularity = _evaluated(spark, root)
    named = {"ER-CBF": lists, "RANDOM": recommend.recommend("RANDOM", train, 20)}
    rows = None
    for name, recs in named.items():
        part = evaluate.evaluate(recs, test, popularity).select(
            F.lit("all").alias("category"), F.lit(name).alias("algorithm"), "n", "novelty"
        )
        rows = part if rows is None else rows.unionByName(part)
    wide = evaluate.metric_pivot(rows, "novelty", list(named))
    return wide.select("category", "n", F.col("ER-CBF").alias("er_cbf"), F.col("RANDOM").alias("random"))


# --- serving


def _table(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    train = durable(with_titles(train_of(spark, root), spark, root))
    lists = recommend.recommend("ER-CBF", train, 20, item_vectors=tables.item_vectors(spark, root))
    return train, recommend.recommendations_table(lists, train, "ER-CBF")


@query
def recommendations_table(spark: SparkSession, root: str) -> DataFrame:
    return _table(spark, root)[1]


def _stored(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All lists in the lookup table of this name; running again replaces them."""
    return serve.store_recommendations(_table(spark, root)[1], name)


@query
def serve_users(spark: SparkSession, root: str) -> DataFrame:
    """Distinct users of the stored table."""
    return serve.list_users(_stored(spark, root, "recommendations_users"))


@query
def serve_history(spark: SparkSession, root: str) -> DataFrame:
    """One user's reviews, from a stored table of all users' reviews."""
    serve.store_history(with_titles(train_of(spark, root), spark, root), "histories")
    return serve.history(spark, "histories", USER)


@query
def serve_top_n(spark: SparkSession, root: str) -> DataFrame:
    """One user's list, looked up in the stored table of all lists."""
    _stored(spark, root, "recommendations_top_n")
    return serve.top_n(spark, "recommendations_top_n", USER, "er-cbf", 10)


@query
def user_report(spark: SparkSession, root: str) -> DataFrame:
    """Recommended items of one user with one title each."""
    train = durable(with_titles(train_of(spark, root), spark, root))
    lists = recommend.recommend("ER-CBF", train, 10, item_vectors=tables.item_vectors(spark, root))
    return recommend.user_report(train, lists, USER)[1]


@query
def common_items(spark: SparkSession, root: str) -> DataFrame:
    reviews = with_titles(tables.reviews(spark, root), spark, root)
    return neighbours.common_items(reviews, *SHARING)


@query
def demo_extract(spark: SparkSession, root: str) -> DataFrame:
    """Lists of sampled users, taken from the stored table and stored as a table of their own."""
    stored = _stored(spark, root, "recommendations_all")
    return serve.store_recommendations(serve.demo_extract(stored, 100, pinned=PINNED), "recommendations_demo")


# --- shapes


@query
def dense_user_index(spark: SparkSession, root: str) -> DataFrame:
    """Users and their numbers from 0, in order of their ids."""
    return numbering.dense_index(tables.reviews(spark, root), "user_id")


@query
def rating_lists_long(spark: SparkSession, root: str) -> DataFrame:
    """Two lists of each user, of different lengths, as one row per entry: items rated above the middle, and the others."""
    rated = train_of(spark, root).groupBy("user_id", "item_id").agg(F.avg("rating").alias("mean"))

    def items_where(condition):
        return F.sort_array(F.collect_list(F.when(condition, F.col("item_id"))))

    wide = rated.groupBy("user_id").agg(
        items_where(F.col("mean") > 3).alias("liked"), items_where(F.col("mean") <= 3).alias("others")
    )
    return reshape.lists_to_long(wide, ["user_id"], ["liked", "others"], "list", "place", "item_id")


@query
def split_sizes_long(spark: SparkSession, root: str) -> DataFrame:
    """Numbers of train and test reviews of each user as one row each."""
    marked = split.mark_split(tables.reviews(spark, root)).groupBy("user_id").agg(
        F.sum((~F.col("is_test")).cast("bigint")).alias("train"), F.sum(F.col("is_test").cast("bigint")).alias("test")
    )
    return reshape.wide_to_long(marked, ["user_id"], ["train", "test"], "part", "n_reviews")


@query
def user_texts(spark: SparkSession, root: str) -> DataFrame:
    """All cleaned train texts of each user in order of time, put together."""
    pieces = reshape.text_pieces(review_tokens(spark, root), "user_id", "processed_text", ["review_date", "review_id"])
    whole = reshape.whole_texts(pieces, "user_id")
    return whole.select("user_id", "n_texts", F.char_length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


@query
def prepare_counts(spark: SparkSession, root: str) -> DataFrame:
    """How many rows the merge and the split saw, dropped by each rule and kept, counted while these are written."""
    ledger = accounting.Ledger()
    reviews, items, texts = tables.reviews(spark, root), tables.items(spark, root), tables.texts(spark, root)
    required = list(dict.fromkeys([*items.columns, "doc_id", *reviews.columns, *texts.columns]))
    # copies of a long text lie further apart than the default compression looks back
    kept = durable(accounting.prepare(reviews, items, required, ledger, texts=texts), compression="zstd")
    for part in accounting.split(kept.select("review_id", "user_id", "item_id", "review_date"), ledger):
        durable(part)
    return ledger.table(spark)


# --- solved factors and the vector index


@query
def mf_als_top10(spark: SparkSession, root: str) -> DataFrame:
    """FUNK-SVD's model by alternating least squares."""
    return recommend.recommend("ALS", durable(train_of(spark, root)), 10)


@query
def mf_errors(spark: SparkSession, root: str) -> DataFrame:
    """Error on train and test pairs of the factors found by gradient descent and by least squares."""
    train, test = (durable(part) for part in split.split_train_test(tables.reviews(spark, root)))
    out = None
    for name in ("FUNK-SVD", "ALS"):
        model = recommend.fit(name, train)
        users, items = durable(model.tables["users"]), durable(model.tables["items"])
        for part, rows in (("train", train), ("test", test)):
            pairs = rows.select("review_id", "user_id", "item_id", "rating")
            scored = factorise.estimate_pairs(users, items, model.params["mean"], pairs.select("user_id", "item_id").distinct())
            error = pairs.join(scored, ["user_id", "item_id"]).agg(F.sqrt(F.avg((F.col("rating") - F.col("score")) ** 2)).alias("rmse"))
            row = error.select(F.lit(name).alias("algorithm"), F.lit(part).alias("part"), rounded(F.col("rmse")).alias("rmse"))
            out = row if out is None else out.unionByName(row)
    return out


@query
def knn_items_approx(spark: SparkSession, root: str) -> DataFrame:
    """The nearest items of every user's mean vector, from an index of all item vectors."""
    vectors = tables.item_vectors(spark, root)
    profiles = durable(content.user_profiles(train_of(spark, root), vectors))
    return index.build(vectors, profiles).nearest(profiles)


@query
def lda_tfidf_top_terms(spark: SparkSession, root: str) -> DataFrame:
    """Top terms of the topic model that is trained on tf-idf weights."""
    return topics.train_topics(processed_texts(spark, root), weights=topics.TFIDF).top_terms(spark)


def flagship(spark: SparkSession, root: str) -> DataFrame:
    """Content-filter lists over review vectors, ten items per user."""
    return ercbf_top10(spark, root)
