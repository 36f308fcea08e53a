"""Spelling variants in a vocabulary: words one edit apart, found by searches in FM-indexes.

An edit leaves one half of a word as it is. So each word is looked up twice: once its first half is matched exactly
and its second half with one error allowed, once the other way round. A search keeps an interval of suffix ranks over the
vocabulary, written as one text in which every word stands between delimiters, and lengthens the match by one letter
at a time; it begins and ends with a delimiter, so that whole words match. A search that goes right needs the index of
the words as they are, one that goes left that of the words reversed; each search goes one way only, so the two
intervals of a bidirectional index need not be kept in step. Backward search on the text of reversed words lengthens to
the right, hence the second search is the first one on reversed words.

The vocabulary is cut into shards. Two words that share a half share its first two letters (words have five or more), and
their lengths differ by one at most: a shard holds the words of one direction with the same two letters and the same length,
and a shard of more than ``SHARD_WORDS`` words is cut by hash, in which case the queries go to all of its parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.session import durable

RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_LETTERS, LEAST_COUNT = 5, 3
SPOILT = 97  # a run whose hash this divides loses a letter
AHEAD = 2  # letters of the exact half by which shards are told; half of the shortest word
SHARD_WORDS = 20_000  # words of an index, on average
QUERY_WORDS = 20_000  # words looked up at a time
RATIO = 2  # how many times as frequent a form is
MOST_STEPS = 64  # a chain of forms at least doubles its count at each step, and counts are below 2**63
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, least: int = LEAST_COUNT, letters: int = LEAST_LETTERS) -> DataFrame:
    """(word, n): words of at least ``letters`` code points that occur ``least`` times or more in ``docs`` (doc_id, text).

    A word is a maximal run of letters (A-Z, a-z, U+00C0 to U+00FF) with A-Z lower-cased. A run loses the letter at
    h % length if SPOILT divides h, the crc32 of ``<doc_id>:<run>``; a missing doc_id is written as an empty text. Null
    texts have no words.
    """
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.translate(F.col("text").cast("string"), UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"),
    )
    # a run of four letters can only lose one
    hashed = runs.where(F.char_length("run") >= letters).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    spot = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), spot), F.substring("run", spot + 2, F.char_length("run")))
    word = F.when(F.col("h") % SPOILT == 0, cut).otherwise(F.col("run"))
    words = hashed.select(word.alias("word")).where(F.char_length("word") >= letters)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, by prefix doubling; a suffix that ends sorts before one that goes on."""
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    n, step = len(text), 1
    order = np.argsort(rank, kind="stable")
    while n > 1:
        behind = np.zeros(n, dtype=np.int64)
        behind[: max(n - step, 0)] = rank[step:] + 1
        key = rank * (n + 1) + behind
        order = np.argsort(key, kind="stable")
        fresh = np.ones(n, dtype=np.int64)
        fresh[0] = 0
        fresh[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(fresh)
        if rank[order[-1]] == n - 1:
            break
        step *= 2
    return order


class Index:
    """FM-index of words written in reverse between delimiters; a search lengthens its match to the right."""

    def __init__(self, words: list[str]):
        text = "\0" + "\0".join(w[::-1] for w in words) + "\0"
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.alphabet, coded = np.unique(points, return_inverse=True)  # the delimiter is 0
        n = len(coded)
        ranks = suffix_array(coded)
        before = coded[ranks - 1]  # the letter before each suffix; before the whole text stands its last delimiter
        self.n = n
        self.starts = np.searchsorted(np.sort(coded), np.arange(len(self.alphabet) + 1))
        # places of each letter among the letters before suffixes, as one sorted list
        self.places = np.sort(before.astype(np.int64) * (n + 1) + np.arange(n))
        self.begins = np.searchsorted(self.places, np.arange(len(self.alphabet) + 1) * (n + 1))
        self.word_at = np.cumsum(coded == 0)[ranks] - 1  # number of the word whose text goes on at each suffix

    def code(self, points: np.ndarray) -> np.ndarray:
        """Letters as numbers; -1 for one that does not occur."""
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at, -1)

    def longer(self, letter: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals [low, high) after one more letter."""
        known = np.maximum(letter, 0)
        base, shift = known * (self.n + 1), self.starts[known] - self.begins[known]
        a = shift + np.searchsorted(self.places, base + low)
        b = shift + np.searchsorted(self.places, base + high)
        return a, np.where(letter >= 0, b, a)


def one_error_later(index: Index, queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) numbers: indexed words that differ from a query by one inserted, deleted or replaced letter, the
    query's first half being matched exactly."""
    length = np.array([len(q) for q in queries], dtype=np.int64)
    letters = np.full((len(queries), int(length.max()) + 1), -1, dtype=np.int64)
    flat = np.frombuffer("".join(queries).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    row = np.repeat(np.arange(len(queries)), length)
    letters[row, np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = index.code(flat)
    half = length // 2
    every = np.arange(1, len(index.alphabet))

    def extended(q, letter, low, high):
        low, high = index.longer(letter, low, high)
        alive = high > low
        return q[alive], low[alive], high[alive], alive

    q = np.arange(len(queries))
    low, high, _ = np.zeros(len(q), dtype=np.int64), np.full(len(q), index.starts[1]), None
    for at in range(int(half.max())):
        on = half[q] > at
        longer = extended(q[on], letters[q[on], at], low[on], high[on])
        q, low, high = (np.concatenate([x[~on], y]) for x, y in zip((q, low, high), longer[:3], strict=True))
    place = half[q]
    wrong: list[tuple] = []  # (query, place, low, high) of matches that have used their error

    def keep(q, place, letter, low, high):
        q2, low, high, alive = extended(q, letter, low, high)
        if len(q2):
            wrong.append((q2, place[alive], low, high))

    while len(q):
        inside = place < length[q]
        # the word lacks this letter of the query
        if inside.any():
            wrong.append((q[inside], place[inside] + 1, low[inside], high[inside]))
        # any letter, in the place of the query's next one, or before it
        many = np.repeat(np.arange(len(q)), len(every))
        letter = np.tile(every, len(q))
        q2, low2, high2, alive = extended(q[many], letter, low[many], high[many])
        at, chosen = place[many][alive], letter[alive]
        if len(q2):
            wrong.append((q2, at, low2, high2))
            other = (at < length[q2]) & (letters[q2, at] != chosen)
            wrong.append((q2[other], at[other] + 1, low2[other], high2[other]))
        q, place, low, high = q[inside], place[inside], low[inside], high[inside]
        q2, low, high, alive = extended(q, letters[q, place], low, high)
        q, place = q2, place[alive] + 1
    if not wrong:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    q, place, low, high = (np.concatenate(x) for x in zip(*wrong, strict=True))
    done: list[tuple] = []
    while len(q):
        ended = place == length[q]
        q2, low2, high2, _ = extended(q[ended], np.zeros(int(ended.sum()), dtype=np.int64), low[ended], high[ended])
        done.append((q2, low2, high2))
        q, place, low, high = q[~ended], place[~ended], low[~ended], high[~ended]
        q, low, high, alive = extended(q, letters[q, place], low, high)
        place = place[alive] + 1
    q, low, high = (np.concatenate(x) for x in zip(*done, strict=True))
    size = high - low
    ranks = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
    # a suffix that begins with the delimiter before a match is followed by that word reversed
    pairs = np.unique(np.stack([np.repeat(q, size), index.word_at[ranks]], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _searched(shard: pa.Table) -> pa.Table:
    """Near pairs (word, near) of one shard: its own words, and those that are looked up in it."""
    reverse = shard["reverse"][0].as_py()
    own = shard.filter(shard["indexed"])["word"].to_pylist()
    asked = shard.filter(pa.compute.invert(shard["indexed"]))["word"].to_pylist()
    found: list[tuple[str, str]] = []
    if own and asked:
        if reverse:
            own, asked = [w[::-1] for w in own], [w[::-1] for w in asked]
        index = Index(own)
        for at in range(0, len(asked), QUERY_WORDS):
            some = asked[at : at + QUERY_WORDS]
            found += [(some[i], own[j]) for i, j in zip(*one_error_later(index, some), strict=True) if some[i] != own[j]]
        if reverse:
            found = [(a[::-1], b[::-1]) for a, b in found]
    return pa.table({k: pa.array([f[i] for f in found], pa.string()) for i, k in enumerate(("word", "near"))})


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, near): all pairs of ``words`` (word, distinct, AHEAD * 2 + 1 letters or more) one edit apart, both ways round."""
    words = words.select("word")
    sides = words.withColumn("reverse", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("letters", F.char_length("word"))
    head = F.when(F.col("reverse"), F.reverse(F.right("word", F.lit(AHEAD)))).otherwise(F.left("word", F.lit(AHEAD)))
    sides = sides.withColumn("head", head)
    keys = ["reverse", "head", "letters"]
    sizes = sides.groupBy(*keys).agg(F.ceil(F.count("*") / shard_words).cast("int").alias("parts"))
    indexed = sides.join(sizes, keys).select(
        *keys, F.pmod(F.xxhash64("word"), F.col("parts")).cast("int").alias("part"), "word", F.lit(True).alias("indexed")
    )
    around = F.explode(F.array(F.col("letters") - 1, F.col("letters"), F.col("letters") + 1))
    asked = sides.select("reverse", "head", around.alias("letters"), "word").join(sizes, keys).select(
        *keys, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "word", F.lit(False).alias("indexed")
    )
    shards = indexed.unionByName(asked).groupBy(*keys, "part")
    # an insertion between the halves is found from both sides
    return shards.applyInArrow(_searched, "word string, near string").distinct()


def spelling_variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``vocabulary(docs)``.

    ``n_near`` counts the words one edit away. ``form`` is the most frequent of them (ties: the smallest in code-point
    order) if it is at least RATIO times as frequent as the word, else null, ``form_n`` its count. ``root`` is the last word
    reached by following forms, the word itself without one. Empty tables give no rows; other columns are not read.
    """
    words = durable(vocabulary(docs))
    pairs = near_words(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = pairs.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best")
    )
    joined = words.join(best, "word", "left")
    near_n = -F.col("best.order")
    has = F.coalesce(near_n >= RATIO * F.col("n"), F.lit(False))
    formed = durable(
        joined.select(
            "word", F.when(has, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(has, near_n).alias("form_n"),
        )
    )
    # each round doubles the distance that a word looks ahead
    ways = durable(formed.where("form is not null").select("word", F.col("form").alias("root")))
    for _ in range(MOST_STEPS):
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ways = durable(
            ways.join(further, "root", "left")
            .select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        )
        moved = ways.where("moved").limit(1).count()
        ways = ways.select("word", "root")
        if not moved:
            break
    return formed.join(ways, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
