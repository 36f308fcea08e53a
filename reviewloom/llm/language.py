"""Language of whole texts by a linear-chain conditional random field over words.

A word's features are its lexicon entry (a hash of the lower-cased word), its first and last one to four bytes, and
its two- and three-byte grams; weights per feature and language, and per pair of neighbouring languages, are learned
together. Forward-backward then gives each word its language probabilities in the light of the whole text, so that a
text that switches is labelled word by word; the text takes the language with the largest sum.

The model is fitted on a bounded sample: from each language about ``SAMPLE_TEXTS`` texts, of each a run of
``SAMPLE_WORDS`` words at a random place, cut to ``SAMPLE_CHARS`` characters. Training sequences join runs of different languages, so that changes are seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm import chain, words
from reviewloom.llm.scope import fields, fold

SAMPLE_TEXTS, SAMPLE_WORDS, SAMPLE_CHARS = 1_500, 40, 1_000
MOST_LANGUAGES = 256  # languages that are learned; more is an error
BUCKETS = 1 << 16  # weights per language and kind of feature are shared by hash
AFFIX = 4
EPOCHS, BATCH, RATE, DECAY = 6, 256, 0.15, 1e-6
FOLDS = 5
LABELLED_BYTES = 256 << 10  # text labelled at a time; one longer text is labelled alone

LETTER = np.zeros(256, dtype=bool)
LETTER[ord("a") : ord("z") + 1] = LETTER[128:] = True

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, n_words long, n_switches long"


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # (BUCKETS, languages) of word features
    grams: np.ndarray  # (BUCKETS, languages) of two- and three-byte grams
    trans: np.ndarray  # (languages, languages), logarithms


def _bucket(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """(words, 1 + 2 * AFFIX) buckets: lexicon entry, then beginnings and ends of one to AFFIX bytes."""
    out = np.empty((len(starts), 1 + 2 * AFFIX), dtype=np.int64)
    out[:, 0] = _bucket(hashes)
    first = last = np.zeros(len(starts), dtype=np.uint64)
    for k in range(AFFIX):
        first = first * np.uint64(257) + np.where(starts + k < ends, data[np.minimum(starts + k, ends - 1)], 0).astype(np.uint64) + np.uint64(1)
        last = last * np.uint64(257) + np.where(ends - 1 - k >= starts, data[np.maximum(ends - 1 - k, starts)], 0).astype(np.uint64) + np.uint64(1)
        out[:, 1 + k] = _bucket(words.mix(first * words.LEFT + np.uint64(k)))
        out[:, 1 + AFFIX + k] = _bucket(words.mix(last * words.RIGHT + np.uint64(k)))
    return out


def gram_buckets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Buckets of the two- and the three-byte gram that begins at each byte of each word, and the words' bounds.

    What lies behind a word counts as blank.
    """
    length = ends - starts
    bounds = np.concatenate([[0], np.cumsum(length)])
    byte = np.repeat(starts - bounds[:-1], length) + np.arange(bounds[-1])
    place = np.arange(bounds[-1]) + 2 * np.repeat(np.arange(len(starts)), length)
    apart = np.full(bounds[-1] + 2 * len(starts), 0x20, dtype=np.int64)
    apart[place] = data[byte]
    two = apart[place] | apart[place + 1] << 8
    three = two | apart[place + 2] << 16
    return two, (three * 2_654_435_761 >> 12) & (BUCKETS - 1), bounds


def word_scores(model: Model, data, starts, ends, hashes) -> np.ndarray:
    """Sum of weights of each word's features, per language."""
    features = word_features(data, starts, ends, hashes)
    out = model.weights[features[:, 0]].astype(np.float64)
    for k in range(1, features.shape[1]):
        out += model.weights[features[:, k]]
    two, three, bounds = gram_buckets(data, starts, ends)
    return out + np.add.reduceat(model.grams[two] + model.grams[three], bounds[:-1], axis=0)


def train(samples: list[tuple[str, str]], seed: int = 5) -> Model:
    """Fit weights to (text, language) samples by stochastic gradient ascent on the log-likelihood of labels."""
    languages = tuple(sorted({lang for _, lang in samples}))
    n = len(languages)
    place = {lang: i for i, lang in enumerate(languages)}
    rng = np.random.default_rng(seed)
    weights, grams = np.zeros((BUCKETS, n)), np.zeros((BUCKETS, n))
    trans = np.zeros((n, n))
    if not samples:
        return Model(languages, weights, grams, trans)
    data, offsets = words.text_bytes(pa.array([t for t, _ in samples], pa.string()))
    data = words.LOWER[data]
    starts, ends, owner = words.word_places(data, offsets)
    features = word_features(data, starts, ends, words.hash_ranges(data, starts, ends))
    two, three, within = gram_buckets(data, starts, ends)
    label = np.array([place[lang] for _, lang in samples])
    runs = np.searchsorted(owner, np.arange(len(samples) + 1))
    sums = [np.full_like(weights, 1e-6), np.full_like(grams, 1e-6), np.full_like(trans, 1e-6)]

    def step(k: int, param: np.ndarray, gradient: np.ndarray, rows=slice(None)) -> None:
        sums[k][rows] += gradient**2
        param[rows] += RATE * (gradient / np.sqrt(sums[k][rows]) - DECAY * param[rows])

    for _ in range(EPOCHS):
        order = rng.permutation(len(samples))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            # up to three runs, of any languages, follow each other in one sequence
            size = np.diff(runs)[chosen]
            picked = np.concatenate([np.arange(runs[i], runs[i + 1]) for i in chosen]) if size.sum() else None
            if picked is None:
                continue
            bounds = np.concatenate([[0], np.cumsum(size)])[np.r_[0 : len(chosen) : 3, len(chosen)]]
            truth = np.repeat(label[chosen], size)
            length = (ends - starts)[picked]
            byte = np.repeat(within[picked] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
            of = np.repeat(np.arange(len(picked)), length)
            scores = weights[features[picked]].sum(axis=1)
            each = grams[two[byte]] + grams[three[byte]]
            scores += np.add.reduceat(each, np.concatenate([[0], np.cumsum(length)[:-1]]), axis=0)
            seg = chain.Segments.of(bounds)
            positive = np.exp(scores - scores.max(axis=1, keepdims=True))
            emit, move = chain.laid_out(positive, seg), np.exp(trans)
            matrices, scales = chain.transfers(emit, seg, move)
            begin, _ = chain.starts(matrices, scales, seg, np.full(n, 1.0 / n))
            ahead = chain.forward(emit, seg, move, begin)
            back = chain.backward(emit, seg, move, chain.ends(matrices, seg))
            here = (ahead * back)[seg.real]
            here /= here.sum(axis=1, keepdims=True)
            # expected and seen pairs of neighbours
            inner = np.ones(len(picked), dtype=bool)
            inner[bounds[:-1][np.diff(bounds) > 0]] = False
            after = np.flatnonzero(inner)
            alpha, beta = ahead[seg.real][after - 1], (back * emit)[seg.real][after]
            pair = alpha[:, :, None] * move[None] * beta[:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            seen = np.zeros((n, n))
            np.add.at(seen, (truth[after - 1], truth[after]), 1.0)
            step(2, trans, (seen - pair.sum(axis=0)) / len(picked))
            error = -here
            error[np.arange(len(picked)), truth] += 1.0
            for k, param, keys, values in (
                (0, weights, features[picked].reshape(-1), np.repeat(error, features.shape[1], axis=0)),
                (1, grams, np.concatenate([two[byte], three[byte]]), np.concatenate([error[of], error[of]])),
            ):
                rows, inverse = np.unique(keys, return_inverse=True)
                total = np.stack([np.bincount(inverse, values[:, j], len(rows)) for j in range(n)], axis=1)
                step(k, param, total / len(picked), rows)
    return Model(languages, weights.astype(np.float32), grams.astype(np.float32), trans)


def samples_of(
    docs: DataFrame, texts: int = SAMPLE_TEXTS, run: int = SAMPLE_WORDS, chars: int = SAMPLE_CHARS
) -> list[tuple[str, str]]:
    """About ``texts`` texts of each language outside the held-out fold, of each ``run`` words from a random place.

    A run of more than ``chars`` characters is cut to so many, again from a random place. Rows are chosen by a hash of
    doc_id and text among all rows; only the runs reach the driver.
    """
    learnable = docs.where((fold("doc_id", FOLDS) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    learnable = learnable.select(F.col("lang").cast("string").alias("lang"), "doc_id", "text")
    counts = learnable.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, texts / r["count"]))])
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(3), "doc_id", "text"), 11) / float(1 << 53)
    listed = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    start = F.pmod(F.xxhash64(F.lit(4), "doc_id", "text"), F.greatest(F.size("w") - run + 1, F.lit(1))) + 1
    picked = (
        learnable.where(drawn < F.element_at(share, F.col("lang")))
        .select("lang", "doc_id", "text", listed.alias("w"))
        .select("lang", F.xxhash64("doc_id", "text").alias("h"), F.array_join(F.slice("w", start.cast("int"), run), " ").alias("run"))
    )
    room = F.greatest(F.char_length("run") - chars + 1, F.lit(1))
    picked = picked.withColumn("run", F.substring("run", F.pmod(F.xxhash64(F.lit(5), "h"), room).cast("int") + 1, F.lit(chars)))
    return [(r["run"], r["lang"]) for r in sorted(picked.collect(), key=lambda r: (r["h"], r["lang"], r["run"]))]


def label_words(model: Model, texts: pa.Array):
    """(probabilities of each word's languages, bounds of texts, whether each word has a letter)."""
    data, offsets = words.text_bytes(texts)
    data = words.LOWER[data]
    starts, ends, owner = words.word_places(data, offsets)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    n = len(model.languages)
    if not len(starts):
        return np.empty((0, n)), bounds, np.empty(0, dtype=bool)
    # features depend on the word alone, so each distinct word is scored once
    hashes, first, word = np.unique(words.hash_ranges(data, starts, ends), return_index=True, return_inverse=True)
    scores = word_scores(model, data, starts[first], ends[first], hashes)
    positive = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -200.0))[word]
    lettered = np.concatenate([[0], np.cumsum(LETTER[data])])
    likely = chain.marginals(positive, bounds, np.exp(model.trans), np.full(n, 1.0 / n))
    return likely, bounds, lettered[ends] > lettered[starts]


def _predict(shared, carry: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        n = len(model.languages)
        names = pa.array([*model.languages, "und"], pa.string())
        for batch in batches:
            for part in words.chunks(batch, limit=LABELLED_BYTES):
                rows = part.num_rows
                best, score = np.full(rows, n), np.zeros(rows)
                switches = np.zeros(rows, dtype=np.int64)
                sizes = np.zeros(rows, dtype=np.int64)
                if n:
                    likely, bounds, lettered = label_words(model, part.column("text"))
                    owner = np.repeat(np.arange(rows), np.diff(bounds))
                    sizes = np.diff(bounds)
                    totals = np.stack(
                        [np.bincount(owner, likely[:, j] * lettered, rows) for j in range(n)], axis=1
                    )
                    count = np.bincount(owner, lettered, rows)
                    has = part.column("has_letter").to_numpy(zero_copy_only=False).astype(bool) & (count > 0)
                    best = np.where(has, totals.argmax(axis=1), n)
                    score = np.where(has, totals.max(axis=1) / np.maximum(count, 1), 0.0).clip(0, 1)
                    label = likely.argmax(axis=1)
                    change = (label[1:] != label[:-1]) & (owner[1:] == owner[:-1])
                    switches = np.bincount(owner[1:][change], minlength=rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()), part.column("held_out").cast(pa.bool_()),
                        names.take(pa.array(best)), pa.array(score), pa.array(sizes.astype(np.int64)),
                        pa.array(switches.astype(np.int64)),
                        *(part.column("text" if c == "text" else f"_carry_{c}") for c in carry),
                    ],
                    names=["doc_id", "held_out", "lang_pred", "score", "n_words", "n_switches", *carry],
                )

    return run


def predicted(docs: DataFrame, model: Model, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_words, n_switches) for every row of ``docs`` (doc_id, text).

    ``score`` is the mean probability of the text's language over its words that have a letter, ``n_switches`` how often
    the likeliest language changes from word to word. Texts without a letter (null, empty, blank) are ``und`` with
    score 0, as is every text if no language was learned; ties go to the name that sorts first. ``held_out`` is false for a
    row without doc_id. Columns named in ``carry`` come along, others are not read.
    """
    parts = (model.languages, model.weights, model.grams, model.trans)  # plain values: executors need no package
    shared = docs.sparkSession.sparkContext.broadcast(parts)
    rows = docs.select(
        "doc_id", F.coalesce(fold("doc_id", FOLDS) == 0, F.lit(False)).alias("held_out"), "text",
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter"),
        *(F.col(c).alias(f"_carry_{c}") for c in carry if c != "text"),  # the text goes to the tasks once
    )
    schema = ", ".join(filter(None, [SCHEMA, fields(docs, carry)]))
    return rows.mapInArrow(_predict(shared, carry), schema)


def identified(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Learn from ``docs`` (doc_id, text, lang) outside the held-out fold, then predict every row."""
    return predicted(docs, train(samples_of(docs)), carry)
