"""The catalogue's queries as plain SQL for an independent engine, on the same tables."""

from __future__ import annotations

import re

from reviewloom.functions.scalar import HASH_ITEM, HASH_MIX, HASH_PRIME, HASH_USER
from reviewloom.functions.text import CONTRACTIONS, STOP_WORDS, TOKEN_MAX, TOKEN_MIN, VERB_ENDINGS
from reviewloom.operators.topics import COHERENCE_EPSILON, MAX_SHARE, MAX_TERMS, MIN_DOCS
from reviewloom.plans.catalog import COLD_START, FACTOR_SCALE, LEMMAS, PINNED, SHARING, USER


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _normalised(column: str) -> str:
    sql = f"lower({column})"
    for short, full in CONTRACTIONS:
        sql = f"replace({sql}, {_quoted(short)}, {_quoted(full)})"
    for pattern, replacement in VERB_ENDINGS:
        sql = f"regexp_replace({sql}, {_quoted(pattern)}, {_quoted(re.sub(r'[$]([0-9])', r'\\\1', replacement))}, 'g')"
    sql = rf"regexp_replace({sql}, '[\r\n]+', ' ', 'g')"
    return f"regexp_replace({sql}, '[^a-z]+', ' ', 'g')"


_STOP = ", ".join(_quoted(w) for w in STOP_WORDS)
_FITS = f"length(w) BETWEEN {TOKEN_MIN} AND {TOKEN_MAX} AND w NOT IN ({_STOP})"

# Named steps; a query takes those it names, in this order.
STEPS = {
    "doc_number": "SELECT count(*) AS n FROM documents",
    "reviews": """
        SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS review_id,
               o_custkey AS user_id, l_partkey AS item_id,
               CAST(1 + CAST(floor(l_quantity) AS BIGINT) % 5 AS DOUBLE) AS rating,
               CAST(l_shipdate AS DATE) AS review_date,
               (l_orderkey * 31 + l_linenumber * 7 + l_partkey) % doc_number.n AS doc_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey CROSS JOIN doc_number""",
    "items": "SELECT p_partkey AS item_id, p_name AS title, p_brand AS brand, p_type AS category FROM part",
    "vec_number": "SELECT count(*) AS n FROM embeddings",
    "item_vectors": """
        SELECT p_partkey AS item_id, CAST(embedding AS DOUBLE[]) AS vec
        FROM part CROSS JOIN vec_number JOIN embeddings ON vec_id = p_partkey % vec_number.n""",
    "user_vectors": """
        SELECT c_custkey AS user_id, CAST(embedding AS DOUBLE[]) AS vec
        FROM customer CROSS JOIN vec_number JOIN embeddings ON vec_id = c_custkey % vec_number.n""",
    "marked": """
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY review_date, review_id) >
                  floor(count(*) OVER (PARTITION BY user_id) * CAST(0.7 AS DOUBLE)) AS is_test
        FROM reviews""",
    "train": "SELECT * EXCLUDE (is_test) FROM marked WHERE NOT is_test",
    "test": """
        SELECT * EXCLUDE (is_test) FROM marked WHERE is_test
        AND user_id IN (SELECT user_id FROM train) AND item_id IN (SELECT item_id FROM train)""",
    "seen": "SELECT DISTINCT user_id, item_id FROM train",
    "cold": f"SELECT user_id, count(item_id) AS n_train FROM train GROUP BY 1 HAVING count(item_id) <= {COLD_START}",
    "means_items": "SELECT item_id, count(review_id) AS rating_count, avg(rating) AS rating_avg FROM reviews GROUP BY 1",
    "means_users": "SELECT user_id, count(review_id) AS rating_count, avg(rating) AS rating_avg FROM reviews GROUP BY 1",
    "weighted_items": """
        SELECT item_id, rating_count, round(rating_avg, 6) AS rating_avg,
               round(rating_count / (rating_count + m) * rating_avg + m / (rating_count + m) * c, 6) AS rating_weighted
        FROM means_items CROSS JOIN
             (SELECT quantile_cont(rating_count, 0.75) AS m, avg(rating_avg) AS c FROM means_items) AS s""",
    "weighted_users": """
        SELECT user_id, rating_count, round(rating_avg, 6) AS rating_avg,
               round(rating_count / (rating_count + m) * rating_avg + m / (rating_count + m) * c, 6) AS rating_weighted
        FROM means_users CROSS JOIN
             (SELECT quantile_cont(rating_count, 0.75) AS m, avg(rating_avg) AS c FROM means_users) AS s""",
    "tokenised": f"""
        SELECT doc_id, [w FOR w IN string_split({_normalised('text')}, ' ') IF {_FITS}] AS tokens FROM documents""",
    "processed": """
        SELECT doc_id, array_to_string(tokens, ' ') AS processed_text, tokens FROM tokenised WHERE len(tokens) > 0""",
    "bow": "SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM processed) AS t GROUP BY 1, 2",
    "doc_freq": "SELECT term, count(*) AS df FROM bow GROUP BY 1",
    "kept_number": "SELECT count(*) AS n FROM processed",
    "profile_values": """
        SELECT user_id, pos, avg(v) AS value
        FROM (SELECT user_id, generate_subscripts(vec, 1) - 1 AS pos, unnest(vec) AS v
              FROM train JOIN item_vectors USING (item_id)) AS t
        GROUP BY 1, 2""",
    "profiles": "SELECT user_id, list(value ORDER BY pos) AS vec FROM profile_values GROUP BY 1",
    "cosines": """
        SELECT user_id, item_id, round(list_cosine_similarity(p.vec, i.vec), 6) + 0.0 AS score
        FROM profiles AS p CROSS JOIN item_vectors AS i""",
    "near": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS place
                       FROM cosines) AS t WHERE place <= 200""",
    "content_lists": """
        SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) - 1 AS INTEGER)
               AS item_rank, item_id, score
        FROM near ANTI JOIN seen USING (user_id, item_id)""",
    "pair_means": "SELECT user_id, item_id, avg(rating) AS r, count(*) AS n FROM train GROUP BY 1, 2",
    "user_means": "SELECT user_id, avg(rating) AS user_mean FROM train GROUP BY 1",
    "devs": "SELECT user_id, item_id, n, user_mean, r - user_mean AS dev FROM pair_means JOIN user_means USING (user_id)",
    "item_devs": "SELECT item_id, avg(dev) AS item_dev FROM devs GROUP BY 1",
    "rated_cells": """
        SELECT user_id, item_id, n, user_mean, item_dev, dev - item_dev AS e FROM devs JOIN item_devs USING (item_id)""",
    "square_sum": "SELECT sum(item_dev * item_dev) AS mm FROM item_devs",
    "terms": """
        SELECT user_id, sum(item_dev * e) AS a, sqrt(mm + 2 * sum(item_dev * e) + sum(e * e)) AS size
        FROM rated_cells CROSS JOIN square_sum GROUP BY user_id, mm""",
    "shared": """
        SELECT x.user_id, y.user_id AS neighbour, sum(x.e * y.e) AS c
        FROM rated_cells AS x JOIN rated_cells AS y ON x.item_id = y.item_id GROUP BY 1, 2""",
    "sims": """
        SELECT u.user_id, v.user_id AS neighbour,
               CASE WHEN u.user_id = v.user_id OR u.size * v.size = 0 THEN 0.0
                    ELSE round((mm + u.a + v.a + coalesce(c, 0)) / (u.size * v.size), 6) + 0.0 END AS sim
        FROM terms AS u CROSS JOIN terms AS v CROSS JOIN square_sum
             LEFT JOIN shared AS s ON s.user_id = u.user_id AND s.neighbour = v.user_id""",
    "nearest": """
        SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY sim DESC, neighbour) AS INTEGER)
                       AS place FROM sims) AS t WHERE place <= 50""",
    "sim_sums": "SELECT user_id, sum(sim) AS sim_sum FROM nearest GROUP BY 1",
    "lists_train_items": "SELECT DISTINCT item_id FROM train",
    "lists_train_users": "SELECT DISTINCT user_id FROM train",
    "moments": "SELECT avg(rating) AS mean, stddev_pop(rating) AS sd FROM train",
    "draws": f"""
        SELECT user_id, item_id,
               round(greatest(1.0, least(5.0, mean + sd * sqrt(-2.0 * ln((x + 1) / {HASH_PRIME + 1}.0::DOUBLE))
                     * cos(2.0 * pi() * ((y + 1) / {HASH_PRIME + 1}.0::DOUBLE)))), 6) AS score
        FROM (SELECT *, ((x * x) % {HASH_PRIME} * {HASH_USER} + user_id) % {HASH_PRIME} AS y
              FROM (SELECT *, ((z * z) % {HASH_PRIME} * {HASH_MIX} + item_id) % {HASH_PRIME} AS x
                    FROM (SELECT user_id, item_id,
                                 ((user_id * {HASH_USER}) % {HASH_PRIME} + (item_id * {HASH_ITEM}) % {HASH_PRIME} + 42)
                                 % {HASH_PRIME} AS z
                          FROM lists_train_users CROSS JOIN lists_train_items) AS t1) AS t2) AS t3
             CROSS JOIN moments""",
    "random_lists": """
        SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) - 1 AS INTEGER)
               AS item_rank, item_id, score
        FROM draws ANTI JOIN seen USING (user_id, item_id)""",
    "popularity": """
        SELECT item_id, count(review_id) AS n_reviews, count(review_id) / max(count(review_id)) OVER () AS popularity
        FROM train GROUP BY 1""",
    "test_pairs": "SELECT DISTINCT user_id, item_id FROM test",
    "test_sizes": "SELECT user_id, count(*) AS actual FROM test GROUP BY 1",
    "recs": """
        SELECT user_id, item_rank, item_id, 'ER-CBF' AS algorithm, title
        FROM content_lists JOIN items USING (item_id) WHERE item_rank < 20""",
}


def _judged(lists: str, lengths: tuple[int, ...]) -> str:
    """Per user and list length: hits, recall, precision, novelty."""
    numbers = ", ".join(f"({n})" for n in lengths)
    return f"""
        SELECT l.user_id, k.n, count(t.item_id) AS hits, count(t.item_id) / any_value(actual) AS recall,
               count(t.item_id) / k.n AS precision, (k.n - coalesce(sum(popularity), 0)) / k.n AS novelty
        FROM {lists} AS l JOIN (VALUES {numbers}) AS k(n) ON l.item_rank < k.n
             JOIN test_sizes USING (user_id)
             LEFT JOIN test_pairs AS t ON t.user_id = l.user_id AND t.item_id = l.item_id
             LEFT JOIN popularity AS p ON p.item_id = l.item_id
        GROUP BY l.user_id, k.n"""


def _five(value: str, source: str, group: str) -> str:
    return f"""
        SELECT CAST(min(v) AS DOUBLE) AS min_value, CAST(max(v) AS DOUBLE) AS max_value,
               round(avg(v), 6) AS avg_value, round(quantile_cont(v, 0.25), 6) AS q25,
               round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.75), 6) AS q75,
               '{group}' AS grouped_by, (SELECT round(avg(rating), 6) FROM {source}) AS global_avg
        FROM (SELECT {group}, {value} AS v FROM {source} GROUP BY 1) AS t"""


_NUMBER_COLUMNS = {"review_id": "bigint", "user_id": "bigint", "item_id": "bigint", "rating": "double",
                   "review_date": "date", "doc_id": "bigint"}
_LEMMA_ROWS = ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in LEMMAS)
_WORDS = r"[w FOR w IN regexp_split_to_array(text, '\s+') IF w <> '']"


def _sizes(col: str) -> str:
    return (
        f"min({col}) AS min_{col}, max({col}) AS max_{col}, round(avg({col}), 6) AS avg_{col}, "
        f"quantile_cont({col}, 0.5) AS median_{col}"
    )


_PREPARED = ("item_id", "title", "brand", "category", "review_id", "user_id", "rating", "review_date", "doc_id", "review_text", "lang")

SELECTS = {
    "reviews_view": "SELECT * FROM reviews",
    "clean_merge": """
        SELECT review_id, item_id, user_id, title, category, rating, md5(text) AS text_md5
        FROM reviews JOIN items USING (item_id) JOIN documents USING (doc_id)
        WHERE (title IS NULL OR NOT contains(title, 'getTime')) AND title <> '' AND category <> '' AND brand <> ''
              AND text <> '' AND lang <> '' AND rating IS NOT NULL AND review_date IS NOT NULL""",
    "sparsity": """
        SELECT round((1 - count(rating) / (count(DISTINCT user_id) * count(DISTINCT item_id))) * 100, 6)
                   AS rating_sparsity,
               round((1 - count(text) / (count(DISTINCT user_id) * count(DISTINCT item_id))) * 100, 6)
                   AS review_sparsity
        FROM reviews JOIN documents USING (doc_id)""",
    "table_shape": "SELECT count(*) AS n_rows, 6 AS n_columns FROM reviews",
    "table_overview": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS column_type, count({c}) AS non_null FROM reviews"
        for c, t in _NUMBER_COLUMNS.items()
    ),
    "describe_reviews": " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_distinct,
                   CAST(arg_max({c}, (n, {c})) AS VARCHAR) AS top, max(n) AS top_freq,
                   round(sum({c} * n) / sum(n), 6) AS avg,
                   (SELECT round(stddev_samp({c}), 6) FROM reviews) AS sd, CAST(min({c}) AS DOUBLE) AS min,
                   (SELECT round(quantile_cont({c}::DOUBLE, 0.25), 6) FROM reviews) AS q25,
                   (SELECT round(quantile_cont({c}::DOUBLE, 0.5), 6) FROM reviews) AS q50,
                   (SELECT round(quantile_cont({c}::DOUBLE, 0.75), 6) FROM reviews) AS q75,
                   CAST(max({c}) AS DOUBLE) AS max
            FROM (SELECT {c}, count(*) AS n FROM reviews GROUP BY 1) AS t"""
        for c in ("user_id", "item_id", "rating")
    ),
    "summary_stats": """
        SELECT count(DISTINCT user_id) AS n_user_id, count(DISTINCT item_id) AS n_item_id,
               count(DISTINCT doc_id) AS n_doc_id FROM reviews""",
    "value_counts_top10": "SELECT item_id, count(*) AS n FROM reviews GROUP BY 1 ORDER BY n DESC, item_id LIMIT 10",
    "reviews_count_stats": _five("count(review_id)", "reviews", "item_id") + " UNION ALL "
    + _five("count(review_id)", "reviews", "user_id"),
    "rating_stats": _five("avg(rating)", "reviews", "item_id") + " UNION ALL "
    + _five("avg(rating)", "reviews", "user_id"),
    "category_rating": """
        SELECT category, round(avg(rating), 6) AS avg_rating FROM reviews JOIN items USING (item_id)
        GROUP BY 1 ORDER BY avg_rating DESC, category LIMIT 10""",
    "category_reviews": """
        SELECT category, count(review_id) AS n_reviews FROM reviews JOIN items USING (item_id)
        GROUP BY 1 ORDER BY n_reviews DESC, category LIMIT 10""",
    "weighted_rating_items": "SELECT * FROM weighted_items",
    "weighted_rating_users": "SELECT * FROM weighted_users",
    "top25_items": "SELECT * FROM weighted_items ORDER BY rating_weighted DESC, item_id LIMIT 25",
    "top25_reviewed_items": "SELECT * FROM weighted_items ORDER BY rating_count DESC, item_id LIMIT 25",
    "text_stats": f"""
        SELECT {_sizes('chars')}, {_sizes('n_words')}
        FROM (SELECT CAST(length(text) AS INTEGER) AS chars, CAST(len({_WORDS}) AS INTEGER) AS n_words
              FROM documents) AS t""",
    "preprocess_text": "SELECT doc_id, processed_text FROM processed",
    "preprocess_lemmas": f"""
        SELECT doc_id, processed_text
        FROM (SELECT doc_id, string_agg(w, ' ' ORDER BY pos) AS processed_text
              FROM (SELECT doc_id, pos, coalesce(lemma, form) AS w
                    FROM (SELECT doc_id, unnest(t) AS form, generate_subscripts(t, 1) AS pos
                          FROM (SELECT doc_id, [w FOR w IN string_split({_normalised('text')}, ' ') IF w <> ''] AS t
                                FROM documents) AS a) AS b
                         LEFT JOIN (VALUES {_LEMMA_ROWS}) AS l(dict_form, lemma) ON form = dict_form) AS c
              WHERE {_FITS} GROUP BY 1) AS d""",
    "token_stats": f"SELECT {_sizes('n_tokens')} FROM (SELECT CAST(len(tokens) AS INTEGER) AS n_tokens FROM tokenised) AS t",
    "distinct_tokens": f"""
        SELECT (SELECT count(DISTINCT w) FROM (SELECT unnest({_WORDS}) AS w FROM documents) AS a) AS n_raw,
               (SELECT count(DISTINCT w) FROM (SELECT unnest(tokens) AS w FROM processed) AS b) AS n_processed""",
    "length_slice": """
        SELECT doc_id, CAST(length(processed_text) AS INTEGER) AS n_chars
        FROM processed ORDER BY length(processed_text), doc_id LIMIT 100 OFFSET 500""",
    "histogram_ratings": """
        SELECT CAST(least(floor((rating_avg - low) / step), 24) AS BIGINT) AS bin,
               round(low + CAST(least(floor((rating_avg - low) / step), 24) AS BIGINT) * step, 6) AS bin_start,
               count(*) AS n
        FROM means_items CROSS JOIN
             (SELECT min(rating_avg) AS low, (max(rating_avg) - min(rating_avg)) / 25.0::DOUBLE AS step
              FROM means_items) AS s
        GROUP BY 1, 2""",
    "histogram_words": f"""
        SELECT CAST(floor(n_words / 10) AS BIGINT) AS bin, round(floor(n_words / 10) * 10, 6) AS bin_start, count(*) AS n
        FROM (SELECT CAST(len({_WORDS}) AS DOUBLE) AS n_words FROM documents) AS t GROUP BY 1, 2""",
    "long_tail": """
        SELECT n_reviews, n_items, CAST(sum(n_items) OVER (ORDER BY n_reviews DESC) AS BIGINT) AS items_at_least,
               quantile
        FROM (SELECT rating_count AS n_reviews, count(*) AS n_items FROM means_items GROUP BY 1) AS a
             CROSS JOIN (SELECT round(quantile_cont(rating_count, 0.8), 6) AS quantile FROM means_items) AS b""",
    "sampled_reviews": """
        SELECT review_id, user_id, item_id FROM reviews
        ORDER BY md5('42:' || CAST(review_id AS VARCHAR)), review_id LIMIT 25""",
    "time_split_counts": """
        SELECT user_id, count(*) AS n_reviews, CAST(sum(CAST(is_test AS INTEGER)) AS BIGINT) AS n_test
        FROM marked GROUP BY 1""",
    "time_split_train": "SELECT review_id, user_id, item_id, rating, review_date FROM train",
    "time_split_test": "SELECT review_id, user_id, item_id, rating, review_date FROM test",
    "cold_start_users": "SELECT * FROM cold",
    "cold_start_share": f"""
        SELECT count(*) AS n_users, CAST(sum(CAST(n <= {COLD_START} AS INTEGER)) AS BIGINT) AS n_cold,
               round(avg(CAST(n <= {COLD_START} AS INTEGER)), 6) AS cold_share
        FROM (SELECT user_id, count(item_id) AS n FROM train GROUP BY 1) AS t""",
    "item_popularity": "SELECT item_id, n_reviews, round(popularity, 6) AS popularity FROM popularity",
    "user_profile_vectors": """
        SELECT user_id, CAST(pos AS INTEGER) AS pos, round(value, 6) + 0.0 AS value FROM profile_values""",
    "knn_items": "SELECT user_id, CAST(place - 1 AS INTEGER) AS item_rank, item_id, score FROM near",
    "ercbf_top10": "SELECT * FROM content_lists WHERE item_rank < 10",
    "ubcf_neighbours": "SELECT user_id, neighbour, sim, place FROM nearest",
    "ubcf_top10": """
        SELECT user_id, item_rank, item_id, score
        FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id
                        ORDER BY n_seen DESC, score DESC NULLS LAST, item_id) - 1 AS INTEGER) AS item_rank
              FROM (SELECT o.user_id, o.item_id, n_seen,
                           round(user_mean + item_dev + part / nullif(sim_sum, 0), 6) + 0.0 AS score
                    FROM (SELECT k.user_id, r.item_id, sum(r.n) AS n_seen, sum(r.e * k.sim) AS part
                          FROM nearest AS k JOIN rated_cells AS r ON r.user_id = k.neighbour
                          GROUP BY 1, 2) AS o
                         ANTI JOIN seen AS s ON s.user_id = o.user_id AND s.item_id = o.item_id
                         JOIN user_means AS m ON m.user_id = o.user_id
                         JOIN item_devs AS d ON d.item_id = o.item_id
                         JOIN sim_sums AS q ON q.user_id = o.user_id) AS t) AS t2
        WHERE item_rank < 10""",
    "ubcf_pair": """
        SELECT p.user_id, p.item_id,
               round(any_value(user_mean) + any_value(item_dev)
                     + coalesce(sum(r.e * k.sim), 0) / nullif(any_value(sim_sum), 0), 6) + 0.0 AS predicted
        FROM test_pairs AS p JOIN user_means AS m ON m.user_id = p.user_id
             JOIN item_devs AS d ON d.item_id = p.item_id JOIN sim_sums AS q ON q.user_id = p.user_id
             LEFT JOIN nearest AS k ON k.user_id = p.user_id
             LEFT JOIN (SELECT user_id, item_id, e FROM rated_cells) AS r
                    ON r.user_id = k.neighbour AND r.item_id = p.item_id
        GROUP BY 1, 2""",
    "mf_score_top10": f"""
        SELECT user_id, item_rank, item_id, score
        FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) - 1 AS INTEGER)
                        AS item_rank
              FROM (SELECT u.user_id, i.item_id,
                           round(greatest(1.0, least(5.0, mean + bu + bi
                                 + {FACTOR_SCALE * FACTOR_SCALE!r}::DOUBLE * list_dot_product(u.vec, i.vec))), 6) AS score
                    FROM (SELECT user_id, avg(rating) - any_value(mean) AS bu, any_value(vec) AS vec, any_value(mean) AS mean
                          FROM train JOIN user_vectors USING (user_id) CROSS JOIN moments GROUP BY 1) AS u
                         CROSS JOIN
                         (SELECT item_id, avg(rating) - any_value(mean) AS bi, any_value(vec) AS vec
                          FROM train JOIN item_vectors USING (item_id) CROSS JOIN moments GROUP BY 1) AS i
                   ) AS t ANTI JOIN seen USING (user_id, item_id)) AS t2
        WHERE item_rank < 10""",
    "random_top10": "SELECT * FROM random_lists WHERE item_rank < 10",
    "rating_moments": "SELECT round(mean, 6) AS mean, round(sd, 6) AS sd FROM moments",
    "bow_counts": "SELECT * FROM bow",
    "dictionary_filter": f"""
        SELECT term, df FROM doc_freq CROSS JOIN kept_number
        WHERE df >= {MIN_DOCS} AND df <= {MAX_SHARE}::DOUBLE * n ORDER BY df DESC, term LIMIT {MAX_TERMS}""",
    "tfidf": """
        SELECT doc_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS weight
        FROM (SELECT doc_id, term, tf * log2(n / df) AS raw
              FROM bow JOIN doc_freq USING (term) CROSS JOIN kept_number) AS t
        WHERE raw <> 0""",
    "term_coherence": f"""
        WITH top AS (
            SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY df DESC, term) AS place
                           FROM (SELECT lang, term, count(*) AS df FROM bow JOIN documents USING (doc_id)
                                 GROUP BY 1, 2) AS t) AS t2 WHERE place <= 10),
        pairs AS (SELECT a.lang, a.term AS ta, b.term AS tb FROM top AS a JOIN top AS b
                  ON a.lang = b.lang AND b.place < a.place),
        joint AS (SELECT ta, tb, count(*) AS n_both
                 FROM (SELECT DISTINCT ta, tb FROM pairs) AS p JOIN bow AS x ON x.term = ta
                      JOIN bow AS y ON y.term = tb AND y.doc_id = x.doc_id GROUP BY 1, 2)
        SELECT lang, round(avg(ln((coalesce(n_both, 0) / n + {COHERENCE_EPSILON!r}::DOUBLE) / (df / n))), 6) + 0.0
                         AS coherence
        FROM pairs LEFT JOIN joint USING (ta, tb) JOIN doc_freq ON doc_freq.term = tb CROSS JOIN kept_number
        GROUP BY 1""",
    "recall_novelty_at_n": f"""
        SELECT n, count(*) AS n_users, round(avg(recall), 6) AS recall, round(avg(novelty), 6) AS novelty
        FROM ({_judged('content_lists', (5, 10, 15, 20))}) AS j GROUP BY 1""",
    "precision_at_n": f"""
        SELECT n, count(*) AS n_users, round(avg(precision), 6) AS precision
        FROM ({_judged('content_lists', (10, 25, 30, 45))}) AS j GROUP BY 1""",
    "cold_start_eval": f"""
        SELECT n, count(*) AS n_users, round(avg(recall), 6) AS recall, round(avg(novelty), 6) AS novelty
        FROM ({_judged('content_lists', (5, 10, 15, 20))}) AS j
        WHERE user_id IN (SELECT user_id FROM cold) GROUP BY 1""",
    "hit_users": f"""
        SELECT user_id, hits, round(recall, 6) AS recall FROM ({_judged('content_lists', (20,))}) AS j
        WHERE recall > 0""",
    "metric_pivot": f"""
        SELECT 'all' AS category, n, er_cbf, random
        FROM (SELECT n, round(avg(novelty), 6) AS er_cbf
              FROM ({_judged('content_lists', (5, 10, 15, 20))}) AS j GROUP BY 1) AS a
             JOIN (SELECT n, round(avg(novelty), 6) AS random
                   FROM ({_judged('random_lists', (5, 10, 15, 20))}) AS j GROUP BY 1) AS b USING (n)""",
    "recommendations_table": "SELECT * FROM recs",
    "serve_users": "SELECT DISTINCT user_id FROM recs",
    "serve_history": f"SELECT item_id, title FROM train JOIN items USING (item_id) WHERE user_id = {USER}",
    "serve_top_n": f"SELECT * FROM recs WHERE user_id = {USER} AND algorithm = 'ER-CBF' ORDER BY item_rank LIMIT 10",
    "user_report": f"SELECT item_id, title FROM recs WHERE user_id = {USER} AND item_rank < 10 ORDER BY item_rank",
    "common_items": f"""
        SELECT item_id, title
        FROM (SELECT item_id FROM reviews WHERE user_id = {SHARING[0]}) AS a
             JOIN (SELECT item_id FROM reviews WHERE user_id = {SHARING[1]}) AS b USING (item_id)
             JOIN items USING (item_id)""",
    "demo_extract": f"""
        SELECT * FROM recs WHERE user_id IN ({', '.join(map(str, PINNED))}) OR user_id IN (
            SELECT user_id FROM (SELECT DISTINCT user_id FROM recs) AS t
            ORDER BY md5('42:' || CAST(user_id AS VARCHAR)), user_id LIMIT 100)""",
    "dense_user_index": """
        SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS index FROM (SELECT DISTINCT user_id FROM reviews) AS t""",
    "rating_lists_long": """
        SELECT user_id, list, CAST(row_number() OVER (PARTITION BY user_id, list ORDER BY item_id) - 1 AS INTEGER) AS place, item_id
        FROM (SELECT user_id, item_id, CASE WHEN avg(rating) > 3 THEN 'liked' ELSE 'others' END AS list
              FROM train GROUP BY 1, 2) AS t""",
    "split_sizes_long": """
        UNPIVOT (SELECT user_id, CAST(sum(CAST(NOT is_test AS INTEGER)) AS BIGINT) AS train,
                        CAST(sum(CAST(is_test AS INTEGER)) AS BIGINT) AS test FROM marked GROUP BY 1)
        ON train, test INTO NAME part VALUE n_reviews""",
    "user_texts": """
        SELECT user_id, count(*) AS n_texts, length(string_agg(processed_text, ' ' ORDER BY review_date, review_id)) AS n_chars,
               md5(string_agg(processed_text, ' ' ORDER BY review_date, review_id)) AS text_md5
        FROM train JOIN processed USING (doc_id) GROUP BY 1""",
    "prepare_counts": f"""
        WITH joined AS (
            SELECT review_id, user_id, item_id, rating, review_date, doc_id, nullif(title, '') AS title, nullif(brand, '') AS brand,
                   nullif(category, '') AS category, nullif(text, '') AS review_text, nullif(lang, '') AS lang
            FROM reviews JOIN items USING (item_id) JOIN documents USING (doc_id)
            WHERE title IS NULL OR NOT contains(title, 'getTime')),
        kept AS (SELECT * FROM joined WHERE {" AND ".join(f"{c} IS NOT NULL" for c in _PREPARED)}),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY review_date, review_id) >
                      floor(count(*) OVER (PARTITION BY user_id) * CAST(0.7 AS DOUBLE)) AS is_test
            FROM kept)
        SELECT 'items' AS step, 'rows' AS measure, count(*) AS n FROM items
        UNION ALL SELECT 'items', 'broken_title', count(*) FILTER (contains(title, 'getTime')) FROM items
        UNION ALL SELECT 'joined', 'rows', count(*) FROM joined
        {" ".join(f"UNION ALL SELECT 'joined', 'no_{c}', count(*) FILTER ({c} IS NULL) FROM joined" for c in _PREPARED)}
        UNION ALL SELECT 'kept', 'rows', count(*) FROM kept
        UNION ALL SELECT 'train', 'rows', count(*) FROM placed WHERE NOT is_test
        UNION ALL SELECT 'test', 'rows', count(*) FROM placed WHERE is_test
            AND user_id IN (SELECT user_id FROM placed WHERE NOT is_test) AND item_id IN (SELECT item_id FROM placed WHERE NOT is_test)""",
}


def _named(sql: str) -> set[str]:
    return {name for name in re.findall(r"[a-z_]+", sql) if name in STEPS}


def statement(select: str) -> str:
    """The select with the steps it needs in front."""
    needed, todo = set(), _named(select)
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo |= _named(STEPS[name])
    if not needed:
        return select.strip()
    steps = ",\n".join(f"{name} AS ({sql.strip()})" for name, sql in STEPS.items() if name in needed)
    select = select.strip()
    if select.startswith("WITH"):
        return f"WITH {steps},\n{select[4:].strip()}"
    return f"WITH {steps}\n{select}"


def statements() -> dict[str, str]:
    return {name: statement(select) for name, select in SELECTS.items()}
