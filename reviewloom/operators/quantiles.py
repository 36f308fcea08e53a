"""Exact quantiles of many series at once, by rank selection in passes over ranges of values.

A pass counts the values of each wanted range in ``BINS`` equal bins. The counts tell which bin holds the wanted rank; its
smallest and largest value are the next range. A range whose ends are equal is the answer. Bins follow the values in
order whatever the rounding, so counts below a bin are exact, and both ends of a range fall into different
bins, so every pass gets on. A task holds one counter per bin and range, however many distinct values there are, and
the driver as many counts; nothing is sorted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.session import durable

BINS = 1024


@dataclass(frozen=True)
class Range:
    """The value of rank ``rank`` (from 0) of a series lies between low and high; ``below`` values are smaller than low."""

    series: str
    rank: int
    low: float
    high: float
    below: int


def _ranks(n: int, p: float) -> tuple[int, int, float]:
    place = (n - 1) * p
    return math.floor(place), math.ceil(place), place - math.floor(place)


def _narrowed(rows: DataFrame, ranges: list[Range]) -> list[Range]:
    """One pass: each range cut to the bin that holds its rank."""
    spans = sorted({(r.series, r.low, r.high) for r in ranges})
    hits = []
    for i, (series, low, high) in enumerate(spans):
        v = F.col("value")
        # halves, as the difference of two large numbers may not fit
        share = F.try_divide(v / 2 - low / 2, F.lit(high / 2 - low / 2))
        bin_ = F.when(v >= high, BINS - 1).otherwise(F.least(F.floor(share * BINS), F.lit(BINS - 2))).cast("int")
        inside = (F.col("series") == series) & v.between(low, high)
        hits.append(F.when(inside, F.struct(F.lit(i).alias("span"), bin_.alias("bin"))))
    counted = (
        rows.select("value", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("hit"))
        .groupBy("hit.span", "hit.bin")
        .agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        .collect()  # at most BINS counts per range
    )
    by_span: dict[int, list] = {}
    for row in sorted(counted, key=lambda r: (r["span"], r["bin"])):
        by_span.setdefault(row["span"], []).append(row)
    out = []
    for r in ranges:
        below = r.below
        for row in by_span[spans.index((r.series, r.low, r.high))]:
            if r.rank < below + row["n"]:
                out.append(replace(r, low=row["low"], high=row["high"], below=below))
                break
            below += row["n"]
    return out


def quantiles(rows: DataFrame, probabilities: Sequence[float]) -> dict[str, list[float | None]]:
    """Quantiles of each series of ``rows`` (series string, value double), between neighbours in proportion.

    Nulls do not count; a series without values has null quantiles. NaN and infinite values are an error.
    """
    rows = rows.select(F.col("series").cast("string").alias("series"), F.col("value").cast("double").alias("value"))
    sizes = rows.groupBy("series").agg(
        F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
    ).collect()
    done: dict[tuple[str, int], float] = {}
    open_ = []
    for s in sizes:
        if not s["n"]:
            continue
        if not (math.isfinite(s["low"]) and math.isfinite(s["high"])):
            raise ValueError(f"{s['series']} holds values that are not finite")
        for rank in sorted({k for p in probabilities for k in _ranks(s["n"], p)[:2]}):
            open_.append(Range(s["series"], rank, s["low"], s["high"], 0))
    while True:
        done |= {(r.series, r.rank): r.low for r in open_ if r.low == r.high}
        open_ = [r for r in open_ if r.low != r.high]
        if not open_:
            break
        open_ = _narrowed(rows, open_)

    def between(s, p):
        if not s["n"]:
            return None
        lower, upper, share = _ranks(s["n"], p)
        a, b = done[s["series"], lower], done[s["series"], upper]
        return a if a == b else (1 - share) * a + share * b

    return {s["series"]: [between(s, p) for p in probabilities] for s in sizes}


def column_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> dict[str, list[float | None]]:
    """Quantiles of several numeric columns in the same passes. ``df`` is written once, as every pass reads it."""
    rows = durable(df.select(*columns))
    pairs = F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).cast("double").alias("value")) for c in columns])
    found = quantiles(rows.select(F.explode(pairs).alias("pair")).select("pair.*"), probabilities)
    return {c: found.get(c, [None] * len(probabilities)) for c in columns}
