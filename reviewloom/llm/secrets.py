"""Secrets in texts: three patterns, and character Markov models that tell random strings from identifiers.

The models are tables of how often one character follows another, in labelled samples taken from all texts: what the
patterns matched is random, other runs of the same characters of ``SAMPLE_LENGTH`` or more are ordinary, but for those
that are themselves to be judged. A run of ``LENGTH`` characters or more, with a digit and a letter, that no pattern matched is reported if random strings explain it better by ``MARGIN``
(natural logarithm of the likelihood ratio).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm import words

# The patterns and the least lengths of what they match.
ASSIGN = re.compile(
    rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "markov")
HINTS = (b"passw", b"secret", b"token", b"api")  # one of them begins every keyword

ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
SIZE = len(ALPHABET)
CODE = np.full(256, SIZE, dtype=np.int64)
CODE[list(ALPHABET)] = np.arange(SIZE)
HEX = np.zeros(256, dtype=bool)
HEX[list(b"0123456789abcdef")] = True
DIGIT = np.zeros(256, dtype=bool)
DIGIT[list(b"0123456789")] = True

SAMPLE_LENGTH, LENGTH, MARGIN = 8, 20, 20.0
SMOOTHING = 0.5  # added to each count
UNIFORM = 0.5  # share of evenly drawn characters in the random model, beside what the labelled samples show

SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long,log_ratio:double>>"


def runs(mask: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the longest stretches where ``mask`` holds, of ``least`` bytes or more."""
    begins, closes = mask.copy(), mask.copy()
    begins[1:] &= ~mask[:-1]
    closes[:-1] &= ~mask[1:]
    edges = offsets[(offsets > 0) & (offsets < len(mask))]
    begins[edges], closes[edges - 1] = mask[edges], mask[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def base_spans(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """(text, start, kind, end, start and end of the secret itself) of the pattern matches, in bytes.

    Matches of one kind do not overlap. A match that is too short is dropped, and what it took stays taken.
    """
    found = []
    raw, low = data.tobytes(), words.LOWER[data].tobytes()
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if any(low.find(hint, a, b) >= 0 for hint in HINTS):
            for m in ASSIGN.finditer(raw, a, b):
                if m.end(2) - m.start(2) >= ASSIGN_LEAST:
                    found.append((i, m.start(), 0, m.end(), m.start(2), m.end(2)))
        if raw.find(b"AKIA", a, b) >= 0:
            for m in ACCESS.finditer(raw, a, b):
                if m.end() - m.start() >= ACCESS_LEAST:
                    found.append((i, m.start(), 1, m.end(), m.start(), m.end()))
    for a, b, i in zip(*(x.tolist() for x in runs(HEX[data], offsets, HEX_LEAST)), strict=True):
        found.append((i, a, 2, b, a, b))
    return sorted(found)


def pairs_in(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How often each character follows each inside the ranges."""
    if not len(starts):
        return np.zeros((SIZE, SIZE))
    length = ends - starts - 1
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
    left, right = codes[at], codes[at + 1]
    known = (left < SIZE) & (right < SIZE)
    return np.bincount(left[known] * SIZE + right[known], minlength=SIZE * SIZE).reshape(SIZE, SIZE).astype(np.float64)


def _judged(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Runs that are long enough to be judged and hold both a digit and a letter."""
    digits = np.concatenate([[0], np.cumsum(DIGIT[data])])
    letters = np.concatenate([[0], np.cumsum(words.LOWER[data] - ord("a") < 26)])
    return (ends - starts >= LENGTH) & (digits[ends] > digits[starts]) & (letters[ends] > letters[starts])


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals = np.zeros((2, SIZE, SIZE))
    for batch in batches:
        for part in words.chunks(batch):
            data, offsets = words.text_bytes(part.column("text"))
            codes = CODE[data]
            secret = {(s, e) for *_, s, e in base_spans(data, offsets)}
            taken = np.array(sorted(secret), dtype=np.int64).reshape(-1, 2)
            random = pairs_in(codes, taken[:, 0], taken[:, 1])
            starts, ends, _ = runs(codes < SIZE, offsets, SAMPLE_LENGTH)
            # a run that a pattern touches is no ordinary one
            reach = np.maximum.accumulate(taken[:, 1]) if len(taken) else taken[:, 1]
            before = np.searchsorted(taken[:, 0], ends) - 1
            touched = (before >= 0) & (reach[np.maximum(before, 0)] > starts) if len(taken) else np.zeros(len(starts), bool)
            ordinary = ~touched & ~_judged(data, starts, ends)
            totals += np.stack([random, pairs_in(codes, starts[ordinary], ends[ordinary])])
    place = np.flatnonzero(totals.reshape(-1))
    yield pa.RecordBatch.from_arrays(
        [pa.array(place.astype(np.int32)), pa.array(totals.reshape(-1)[place])], names=["pair", "n"]
    )


def learned(docs: DataFrame) -> np.ndarray:
    """Logarithms of the likelihood ratio of each character given the one before, random against ordinary.

    Counted over all texts; the two tables have a fixed size.
    """
    counts = docs.select("text").mapInArrow(_learn, "pair int, n double").groupBy("pair").agg(F.sum("n").alias("n"))
    totals = np.zeros(2 * SIZE * SIZE)
    for r in counts.collect():
        totals[r["pair"]] = r["n"]
    random, ordinary = totals.reshape(2, SIZE, SIZE) + SMOOTHING
    random, ordinary = (t / t.sum(axis=1, keepdims=True) for t in (random, ordinary))
    return np.log(UNIFORM / SIZE + (1 - UNIFORM) * random) - np.log(ordinary)


def markov_spans(data: np.ndarray, offsets: np.ndarray, ratio: np.ndarray, taken: list[tuple]) -> list[tuple]:
    """(text, start, kind, end, log ratio) of runs with a digit and a letter that look random and touch no match."""
    codes = CODE[data]
    starts, ends, text = runs(codes < SIZE, offsets, LENGTH)
    if not len(starts):
        return []
    padded = np.zeros((SIZE + 1, SIZE + 1))
    padded[:SIZE, :SIZE] = ratio
    steps = np.concatenate([[0.0], np.cumsum(padded[codes[:-1], codes[1:]])])
    total = steps[ends - 1] - steps[starts]
    fits = (total >= MARGIN) & _judged(data, starts, ends)
    known = sorted((start, end) for _, start, _, end, *_ in taken)
    begin = np.array([a for a, _ in known], dtype=np.int64)
    reach = np.maximum.accumulate(np.array([b for _, b in known], dtype=np.int64)) if known else begin
    out = []
    for k in np.flatnonzero(fits).tolist():
        a, b = int(starts[k]), int(ends[k])
        before = int(np.searchsorted(begin, b)) - 1
        if before < 0 or reach[before] <= a:
            out.append((int(text[k]), a, 3, b, float(total[k])))
    return out


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in batches:
            for part in words.chunks(batch):
                data, offsets = words.text_bytes(part.column("text"))
                base = base_spans(data, offsets)
                spans = sorted([(*s[:4], math.nan) for s in base] + markov_spans(data, offsets, ratio, base))
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                text, start, kind, end, score = (np.array(x) for x in zip(*spans, strict=True)) if spans else [np.empty(0, int)] * 5
                origin = points[offsets[text.astype(int)]]
                entries = pa.StructArray.from_arrays(
                    [
                        pa.array(list(KINDS), pa.string()).take(pa.array(kind.astype(np.int64))),
                        pa.array((points[start.astype(int)] - origin).astype(np.int64)),
                        pa.array((points[end.astype(int)] - origin).astype(np.int64)),
                        pa.array(score.astype(np.float64), mask=np.isnan(score.astype(np.float64))),
                    ],
                    names=["kind", "start", "end", "log_ratio"],
                )
                bounds = np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), entries)],
                    names=["doc_id", "spans"],
                )

    return run


def secret_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for every row of ``docs`` (doc_id, text); spans in code points, end exclusive.

    Spans are ordered by start, then assign, access, hex, markov. A null text is empty. Spans of the
    patterns can overlap those of another pattern; markov spans overlap none. Texts without any sample leave both models
    near even, and nothing is added. Repeated rows give repeated results. Other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(learned(docs))
    return docs.mapInArrow(_scan(shared), SCHEMA)


def listed(spans, kinds: tuple[str, ...] = KINDS):
    """The spans of some kinds as kind:start:end, joined by commas."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
