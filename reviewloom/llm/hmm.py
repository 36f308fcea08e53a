"""Log-probability of whole texts under a hidden Markov language model and a smoothed unigram model.

Words are counted over all training texts. A hidden Markov model with ``STATES`` latent states emits word classes: the
``SINGLES`` most frequent words are classes of their own, all others fall into ``HASHED`` classes by hash, and inside a
class a word has its smoothed share of the class's count (one more type stands for unseen words). So the model covers any
vocabulary with a table of fixed size. Baum-Welch starts with ``SAMPLE_ROUNDS`` rounds over about ``SAMPLE_SPANS`` spans on
the driver. Then it runs over all training tokens, ``ROUNDS`` times at least and until a round gains less than ``SETTLED``
in log-likelihood per token: each task adds up expected counts, which are summed in a tree. For that, texts are cut into
spans of ``SPAN`` tokens; the score of a text is the exact scaled forward recursion over all of it.

Counts of frequent words, at most ``FREQUENT``, are broadcast; tokens of other words meet their counts in a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm import chain, words
from reviewloom.llm.scope import fold
from reviewloom.session import durable

FOLDS, HELD_OUT = 5, 1
STATES, SINGLES, HASHED = 8, 1_024, 1_024
CLASSES = SINGLES + HASHED
FREQUENT = 300_000  # words whose counts are broadcast, 18 bytes each
SPAN, ROUNDS = 128, 3  # tokens of a training span, and least rounds of Baum-Welch over all training tokens
SETTLED = 1e-3  # gain per token, in natural logarithms, under which a round over all training tokens is the last
SAMPLE_SPANS, SAMPLE_ROUNDS = 3_000, 15  # spans, about, and rounds of the start on the driver
PRIOR = 200.0  # class counts, shaped like the corpus, that smooth each state
CUT = 512  # spans whose vectors are held at a time
FAN = 16  # tables of expected counts that are added at a time
COUNTED = 1 << 20  # distinct words a task holds before it hands on their counts

TOKENS = (
    "row long, doc_id long, held_out boolean, training boolean, n_tokens long, n_frequent long, log_counts double, "
    "log_shares double, classes binary, rare array<long>"
)


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and of the end after them, and the bounds of each text."""
    hashes, owner = words.word_hashes(texts)
    n = len(texts)
    out = np.full(len(hashes) + n, words.END, dtype=np.uint64)
    out[np.arange(len(hashes)) + owner] = hashes
    bounds = np.searchsorted(owner, np.arange(n + 1)) + np.arange(n + 1)
    return out, bounds


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, counts = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)

    def out():
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["token", "n"])

    for batch in batches:
        for part in words.chunks(batch, limit=4 << 20):
            found, seen = np.unique(tokens_of(part.column("text"))[0], return_counts=True)
            keys, place = np.unique(np.concatenate([keys, found]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, seen]), len(keys)).astype(np.int64)
            if len(keys) > COUNTED:
                yield out()
                keys, counts = keys[:0], counts[:0]
    yield out()


@dataclass(frozen=True)
class Vocabulary:
    """Counts and classes of frequent words, and totals of all training tokens."""

    tokens: np.ndarray  # hashes of frequent words, ascending
    counts: np.ndarray
    classes: np.ndarray
    total: int
    types: int
    class_mass: np.ndarray  # smoothed count of each class

    @property
    def base(self) -> float:
        """What smoothed counts are divided by."""
        return self.total + 0.5 * (self.types + 1)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From all (token, c). Frequent words: those at least as frequent as leaves at most FREQUENT of them."""
    level = F.floor(F.log2("c") * 8).cast("int")
    hashed = F.pmod(F.shiftrightunsigned("token", 8), F.lit(HASHED)).cast("int")
    levels = counts.groupBy(level.alias("level")).agg(F.count("*").alias("types"), F.sum("c").alias("c")).collect()
    least, held = 0, 0
    for r in sorted(levels, key=lambda r: -r["level"]):
        held += r["types"]
        if held > FREQUENT:
            least = r["level"] + 1
            break
    top = counts.where(level >= least).toArrow()
    keys, seen = top["token"].to_numpy().view(np.uint64), top["c"].to_numpy()
    order = np.argsort(keys)
    keys, seen = keys[order], seen[order]
    classes = (SINGLES + (keys >> np.uint64(8)) % np.uint64(HASHED)).astype(np.int16)
    single = np.lexsort((keys, -seen))[:SINGLES]
    mass = np.zeros(CLASSES)
    for r in counts.groupBy(hashed.alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("types")).collect():
        mass[SINGLES + r["k"]] = r["c"] + 0.5 * r["types"]
    mass[SINGLES:] += 0.5  # the unseen type of each hashed class
    np.subtract.at(mass, classes[single], seen[single] + 0.5)
    classes[single] = np.arange(len(single))
    mass[: len(single)] = seen[single] + 0.5
    return Vocabulary(keys, seen, classes, sum(r["c"] for r in levels), sum(r["types"] for r in levels), mass)


def _tokenise(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary(*shared.value)
        log_mass = np.log10(np.maximum(vocab.class_mass, 1e-300))
        for batch in batches:
            for part in words.chunks(batch):
                n = part.num_rows
                tokens, bounds = tokens_of(part.column("text"))
                place = np.searchsorted(vocab.tokens, tokens)
                place[place == len(vocab.tokens)] = 0
                frequent = vocab.tokens[place] == tokens if len(vocab.tokens) else np.zeros(len(tokens), dtype=bool)
                classes = (SINGLES + (tokens >> np.uint64(8)) % np.uint64(HASHED)).astype(np.int16)
                log_counts = np.zeros(len(tokens))
                if len(vocab.tokens):
                    classes = np.where(frequent, vocab.classes[place], classes)
                    log_counts = np.where(frequent, np.log10(vocab.counts[place] + 0.5), 0.0)
                shares = np.where(classes >= SINGLES, log_counts - log_mass[classes], 0.0)
                rare = np.flatnonzero(~frequent)
                raw = classes.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"), part.column("doc_id").cast(pa.int64()), part.column("held_out"),
                        part.column("training"), pa.array(np.diff(bounds).astype(np.int64)),
                        pa.array(np.add.reduceat(frequent, bounds[:-1], dtype=np.int64)),
                        pa.array(np.add.reduceat(log_counts, bounds[:-1])),
                        pa.array(np.add.reduceat(shares, bounds[:-1])),
                        pa.array([raw[2 * a : 2 * b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
                        pa.ListArray.from_arrays(
                            pa.array(np.searchsorted(rare, bounds).astype(np.int32)),
                            pa.array(tokens[rare].view(np.int64)),
                        ),
                    ],
                    names=[f.split()[0] for f in TOKENS.split(", ")],
                )

    return run


@dataclass(frozen=True)
class Model:
    initial: np.ndarray  # (STATES,) before the first token
    trans: np.ndarray  # (STATES, STATES)
    emission: np.ndarray  # (CLASSES, STATES)


def expected(model: Model, spans: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Expected counts of one forward-backward pass as one vector, its last entry the log-likelihood.

    ``spans`` is (spans, SPAN) classes, padded; ``first`` marks spans that begin a text.
    """
    states, n = len(model.initial), len(spans)
    # longest spans first, so that those with a token at t are the first live[t]; arrays are (SPAN, states, spans)
    order = np.argsort(-sizes, kind="stable")
    spans, sizes, first = np.ascontiguousarray(spans[order].T), sizes[order], first[order]
    live = np.searchsorted(-sizes, -np.arange(SPAN))
    middle = model.trans.mean(axis=0)
    emission, trans = np.ascontiguousarray(model.emission.T), np.ascontiguousarray(model.trans.T)
    ahead = np.empty((SPAN + 1, states, n))
    ahead[0] = np.where(first[None, :], model.initial[:, None], middle[:, None])
    emit = np.empty((SPAN, states, n))
    totals = np.ones((SPAN, n))
    for t in range(SPAN):
        m = live[t]
        np.take(emission, spans[t, :m], axis=1, out=emit[t, :, :m], mode="clip")
        now = (trans @ ahead[t, :, :m]) * emit[t, :, :m]
        totals[t, :m] = now.sum(axis=0)
        ahead[t + 1, :, :m] = now / totals[t, :m]
    # scaled by the same totals, so that ahead * back adds up to one
    back = np.ones((states, n))
    moves = np.zeros((states, states))
    occupied = np.empty((states, int(sizes.sum())))
    flat = np.empty(occupied.shape[1], dtype=np.int64)
    at = 0
    for t in reversed(range(SPAN)):
        m = live[t]
        np.multiply(ahead[t + 1, :, :m], back[:, :m], out=occupied[:, at : at + m])
        flat[at : at + m] = spans[t, :m]
        at += m
        inside = emit[t, :, :m] * back[:, :m] / totals[t, :m]
        moves += ahead[t, :, :m] @ inside.T
        back[:, :m] = model.trans @ inside
    start = (ahead[0] * back)[:, first].sum(axis=1)
    counts = np.stack([np.bincount(flat, o, CLASSES) for o in occupied], axis=1)
    return np.concatenate([start, (moves * model.trans).reshape(-1), counts.reshape(-1), [np.log(totals).sum()]])


def improved(counts: np.ndarray, prior: np.ndarray) -> Model:
    """Parameters from expected counts, smoothed so that every class can follow in every state."""
    s = STATES
    start, moves = counts[:s] + 1.0, counts[s : s + s * s].reshape(s, s) + 1.0
    emission = counts[s + s * s : -1].reshape(CLASSES, s) + PRIOR * prior[:, None]
    return Model(
        start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emission / emission.sum(axis=0, keepdims=True)
    )


def random_model(prior: np.ndarray, seed: int = 9) -> Model:
    rng = np.random.default_rng(seed)
    emission = prior[:, None] * np.exp(rng.normal(0.0, 0.5, (CLASSES, STATES)))
    trans = rng.uniform(0.5, 1.5, (STATES, STATES)) + 4.0 * np.eye(STATES)
    return Model(
        np.full(STATES, 1.0 / STATES), trans / trans.sum(axis=1, keepdims=True),
        emission / np.maximum(emission.sum(axis=0, keepdims=True), 1e-300),
    )


def spans_of(classes: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts cut into spans: (spans, SPAN) classes, their sizes, and which begin a text."""
    texts = [np.frombuffer(c, dtype=np.int16) for c in classes]
    counts = np.array([-(-len(t) // SPAN) for t in texts], dtype=np.int64)
    out = np.zeros((counts.sum(), SPAN), dtype=np.int64)
    sizes, first = np.full(len(out), SPAN), np.zeros(len(out), dtype=bool)
    at = 0
    for t, n in zip(texts, counts, strict=True):
        if n:
            out[at : at + n].reshape(-1)[: len(t)] = t
            sizes[at + n - 1] = len(t) - SPAN * (n - 1)
            first[at] = True
        at += n
    return out, sizes, first


def _expect(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        total = None
        for batch in batches:
            for part in words.chunks(batch, "classes", 1 << 18):
                spans, sizes, first = spans_of(part.column("classes").to_pylist())
                for at in range(0, len(spans), CUT):
                    cut = slice(at, at + CUT)
                    counts = expected(model, spans[cut], sizes[cut], first[cut])
                    total = counts if total is None else total + counts
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    return run


def _added(tables: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), dtype=np.float64) for x in tables["counts"])
    return pa.table({"part": [0], "counts": pa.array([total.tobytes()], pa.binary())}, schema=pa.schema(
        [("part", pa.int32()), ("counts", pa.binary())]
    ))


def _summed(tables: DataFrame) -> np.ndarray | None:
    """All tables of expected counts, added FAN at a time until few are left."""
    tables = durable(tables.select(F.monotonically_increasing_id().alias("id"), "counts"))
    parts = tables.count()
    while parts > FAN:
        parts = math.ceil(parts / FAN)
        spread = tables.select(F.pmod(F.xxhash64("counts"), F.lit(parts)).cast("int").alias("part"), "counts")
        tables = durable(spread.groupBy("part").applyInArrow(_added, "part int, counts binary"))
        parts = tables.count()
    found = [np.frombuffer(r["counts"], dtype=np.float64) for r in tables.select("counts").collect()]
    return sum(found) if found else None


def baum_welch(tokens: DataFrame, prior: np.ndarray) -> tuple[Model, list[float]]:
    """A model fitted to the training rows of ``tokens``, and the log-likelihood before each round over all of them."""
    model = random_model(prior)
    spark = tokens.sparkSession
    training = tokens.where("training").select("classes", "row", "n_tokens")
    n, size = training.agg(F.count("*"), F.sum("n_tokens")).first()
    if not n:
        return model, []
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(6), "row"), 11) / float(1 << 53) < min(1.0, SAMPLE_SPANS / n)
    start = F.pmod(F.xxhash64(F.lit(7), "row"), F.greatest(F.col("n_tokens") - SPAN + 1, F.lit(1))).cast("int") * 2 + 1
    sample = training.where(drawn).orderBy("row").select(F.substring("classes", start, F.lit(2 * SPAN)).alias("c"))
    spans, sizes, first = spans_of([bytes(r["c"]) for r in sample.collect()])
    for _ in range(SAMPLE_ROUNDS if len(spans) else 0):
        cuts = [slice(at, at + CUT) for at in range(0, len(spans), CUT)]
        model = improved(sum(expected(model, spans[c], sizes[c], first[c]) for c in cuts), prior)
    trace = []
    # a log-likelihood has a bound, so gains of SETTLED a token come to an end
    while len(trace) < ROUNDS or trace[-1] - trace[-2] >= SETTLED * size:
        shared = spark.sparkContext.broadcast((model.initial, model.trans, model.emission))
        counts = _summed(training.select("classes").mapInArrow(_expect(shared), "counts binary"))
        shared.unpersist()
        if counts is None:
            break
        trace.append(float(counts[-1]))
        model = improved(counts, prior)
    return model, trace


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            for part in words.chunks(batch, "classes", 1 << 18):
                raw = b"".join(part.column("classes").to_pylist())
                sizes = pa.compute.binary_length(part.column("classes")).to_numpy().astype(np.int64) // 2
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                emit = model.emission[np.frombuffer(raw, dtype=np.int16)]
                sums = chain.log_sums(emit, bounds, model.trans, model.initial) / np.log(10.0)
                kept = [c for c in part.schema.names if c != "classes"]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), pa.array(sums)], names=[*kept, "log_classes"]
                )

    return run


def scored(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs`` (doc_id, text).

    Both scores are base-10 logarithms over all tokens: the lower-cased words and one end. Null and empty texts have the
    end alone. Texts whose crc32(doc_id) modulo 5 is not 1 are learned from; a row without doc_id is not learned from, and not
    held out. Repeated rows count each time. Without training texts every token is unseen. Other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    counts = durable(
        docs.where(fold("doc_id", FOLDS) != HELD_OUT).select("text").mapInArrow(_count, "token long, n long")
        .groupBy("token").agg(F.sum("n").alias("c"))
    )
    vocab = vocabulary(counts)
    parts = (vocab.tokens, vocab.counts, vocab.classes, vocab.total, vocab.types, vocab.class_mass)
    shared = spark.sparkContext.broadcast(parts)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        F.coalesce(fold("doc_id", FOLDS) != HELD_OUT, F.lit(False)).alias("training"), "text",
    )
    tokens = durable(rows.mapInArrow(_tokenise(shared), TOKENS))
    model, _ = baum_welch(tokens, vocab.class_mass / vocab.class_mass.sum())
    rare = (
        tokens.select("row", F.explode("rare").alias("token")).join(counts, "token", "left")
        .groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_logs"), F.count("c").alias("rare_known"))
    )
    fitted = spark.sparkContext.broadcast((model.initial, model.trans, model.emission))
    kept = [f for f in TOKENS.split(", ") if f.split()[0] not in ("training", "classes", "rare")]
    names = [f.split()[0] for f in kept]
    forward = tokens.select(*names, "classes").mapInArrow(_score(fitted), ", ".join([*kept, "log_classes double"]))
    logs = F.coalesce("rare_logs", F.lit(0.0))
    return forward.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_frequent") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("log_counts") + logs - F.col("n_tokens") * math.log10(vocab.base)).alias("base_score"),
        (F.col("log_classes") + F.col("log_shares") + logs).alias("score"),
    )
