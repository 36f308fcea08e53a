"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is wanted ``target / size of the source`` times. The whole part is certain; what is left
is a probability that must become 0 or 1. Two documents with open probabilities trade: words are moved from one to
the other, in a direction drawn so that neither expectation changes, until one of them is settled. The words
that the two are expected to give stay the same, so a source's words differ from its target by half of the
one document at most that stays open to the end and is rounded. Trades run inside blocks of a source; what a block
leaves open goes up a tree of blocks.

In a trade the one with fewer words to give is settled, so a long document would stay open to the end. Documents trade from the
longest to the shortest. One that is more than ``LONGER`` times as long as the next is settled by a draw at once, and
the words that this adds or takes are spread over the chances of all shorter ones, in proportion to what they can give
either way; no expectation changes by that. If they cannot make up for both outcomes, and the document is more than
``MUCH_LONGER`` times as long as the next, the outcome that they can make up for is taken: the target goes before the
chance of a document of such length. Else it trades on, and may be the one that is rounded.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.scope import fields
from reviewloom.session import durable

BLOCK_ROWS = 8_192  # documents that trade in one group, on average
MOST_COPIES = 3.0  # of a document, and of a source's words
WORD = r"[^\x20\x09-\x0D]+"
LONGER, MUCH_LONGER = 2.0, 10.0  # how many times the next document's length a document has that is settled at once
MOST_SOURCES = 1_000_000  # sources whose totals the driver holds (a name and two numbers each)

FIELDS = "row long, source string, doc_id long, size long, copies long, open double"
OWN = ("row", "source", "doc_id", "size", "copies", "open")


@dataclass(frozen=True)
class Share:
    """What one source has and what it should give."""

    source: str | None
    size: int
    rows: int
    target: float

    @property
    def rate(self) -> float:
        return min(self.target / self.size, MOST_COPIES) if self.size else 0.0


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shares(totals: list[tuple[str | None, int, int]], weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> list[Share]:
    """Targets per source of (source, size, rows): weights in code point order of the names, null last.

    A target above MOST_COPIES times its source is cut there; the excess is shared among the others by
    weight, until none is above.
    """
    ordered = sorted(totals, key=lambda t: (t[0] is None, t[0] or ""))
    weight = [float(weights[i % len(weights)]) for i in range(len(ordered))]
    whole = sum(size for _, size, _ in ordered)
    full: set[int] = set()
    while True:
        free = [i for i in range(len(ordered)) if i not in full]
        rest = whole - sum(MOST_COPIES * ordered[i][1] for i in full)
        base = sum(weight[i] for i in free)
        goal = {i: rest * weight[i] / base for i in free}
        above = {i for i in free if goal[i] > MOST_COPIES * ordered[i][1]}
        if not above:
            break
        full |= above
    return [
        Share(name, size, rows, goal.get(i, MOST_COPIES * size)) for i, (name, size, rows) in enumerate(ordered)
    ]


def trade(sizes: np.ndarray, chances: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Settle chances to 0 or 1 but for one at most, keeping the sum of sizes times chances. Sizes fall."""
    out = chances.copy()
    open_ = np.flatnonzero((chances > 0.0) & (chances < 1.0))
    held = -1
    for at, i in enumerate(open_):
        if held >= 0 and sizes[held] > LONGER * sizes[i]:
            # lengths halve from one such document to the next, so there are few
            later = open_[at:]
            settled, out[later] = _spread(float(sizes[held]), float(out[held]), sizes[later], out[later], draws[held])
            if settled is not None:
                out[held], held = settled, -1
        out[i] = _whole(out[i])
        if not 0.0 < out[i] < 1.0:
            continue
        if held < 0:
            held = i
            continue
        a, b = float(sizes[held]), float(sizes[i])
        p, q = float(out[held]), float(out[i])
        up = min((1.0 - p) * a, q * b)  # words that can move from i to the one held
        down = min(p * a, (1.0 - q) * b)  # and back
        if draws[i] * (up + down) < down:
            p, q = (1.0 if up == (1.0 - p) * a else p + up / a), (0.0 if up == q * b else q - up / b)
        else:
            p, q = (0.0 if down == p * a else p - down / a), (1.0 if down == (1.0 - q) * b else q + down / b)
        p, q = _whole(p), _whole(q)
        out[held], out[i] = p, q
        open_p, open_q = 0.0 < p < 1.0, 0.0 < q < 1.0
        held = held if open_p else i if open_q else -1
    return out


def _spread(a: float, p: float, sizes: np.ndarray, chances: np.ndarray, draw: float) -> tuple[float | None, np.ndarray]:
    """Settle a document of size a and chance p against shorter ones: its outcome (None: not settled) and their chances."""
    room = np.minimum(chances / (1.0 - p), (1.0 - chances) / p)
    total = float(room @ sizes)
    if total >= a:
        chosen = (draw * (1 << 26)) % 1.0 < p  # the lower digits of the draw, which decide no trade
        step = room * (a / total)
        moved = chances - (1.0 - p) * step if chosen else chances + p * step
        return float(chosen), np.clip(moved, 0.0, 1.0)
    if a > MUCH_LONGER * sizes[0]:
        give, take = float(chances @ sizes), float((1.0 - chances) @ sizes)
        if (1.0 - p) * a <= give:
            return 1.0, chances * (1.0 - (1.0 - p) * a / give)
        if p * a <= take:
            return 0.0, chances + (1.0 - chances) * (p * a / take)
    return None, chances


def _whole(x: float) -> float:
    """0 or 1 if that is what rounding errors have left."""
    return float(round(x)) if abs(x - round(x)) < 1e-12 else x


def _settle(last: bool, carry: tuple[str, ...]):
    """Trade among the rows of a block; at the last level the one document still open is rounded."""

    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        block = block.sort_by([("size", "descending"), ("order", "ascending"), ("doc_id", "ascending")])
        chances = trade(block["size"].to_numpy(), block["open"].to_numpy(), block["draw"].to_numpy())
        if last:
            chances = np.where((chances > 0) & (chances < 1), chances >= 0.5, chances).astype(np.float64)
        settled = block.select(OWN[:-1]).append_column("open", pa.array(chances))
        for name in carry:
            settled = settled.append_column(name, block[name])
        return settled

    return run


def _draw(seed: int, *names: str) -> Column:
    """A number in [0, 1) that depends on the row's values only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *names), 11) / float(1 << 53)


def mixed(
    docs: DataFrame, seed: int = 0, weights: tuple[float, ...] = (1.0, 2.0, 3.0), carry: tuple[str, ...] = ()
) -> DataFrame:
    """(row, doc_id, source, size, source_size, target, copies, taken) for every row of ``docs`` (doc_id, text, source).

    ``size`` counts the words of the whole text (null: 0), ``copies`` how often the mix takes the document (0 to 3),
    ``taken`` the words that makes. A null source is a source of its own. Documents without words are taken as often as
    is certain, and give nothing. Draws depend on doc_id, size and seed, so that runs agree; rows that are equal in
    these are interchangeable. Rows without doc_id take part. ``row`` numbers the rows of this result.
    Columns named in ``carry`` come along, others are not read.
    """
    rows = durable(
        docs.select(
            "doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), *carry
        )
        .withColumn("row", F.monotonically_increasing_id())
    )
    found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    totals = [tuple(r) for r in found.limit(MOST_SOURCES + 1).collect()]
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    spark = docs.sparkSession
    plan_schema = "source string, source_size long, target double, rate double, blocks int, key int"
    plan = spark.createDataFrame(
        [
            (s.source, s.size, s.target, s.rate, max(1, math.ceil(s.rows / BLOCK_ROWS)), i)
            for i, s in enumerate(shares(totals, weights) if totals else [])
        ],
        plan_schema,
    )
    plan = F.broadcast(plan) if len(totals) <= 10_000 else plan
    planned = plan.select(F.col("source").alias("_source"), "rate", "blocks", "key")
    wanted = (
        rows.join(planned, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("copies", F.floor("rate").cast("long"))
        .withColumn("open", F.when(F.col("size") > 0, F.col("rate") - F.floor("rate")).otherwise(0.0))
    )
    kept = [*OWN, *carry]
    schema = ", ".join(filter(None, [FIELDS, fields(docs, carry)]))
    settled = wanted.where("open <= 0").select(kept)
    trading = wanted.where("open > 0").withColumn(
        "block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.col("blocks")).cast("int")
    )
    trading = trading.select(*kept, "key", "block")
    blocks = max((math.ceil(r[2] / BLOCK_ROWS) for r in totals), default=1)
    level = 0
    while True:
        last = blocks <= 1
        drawn = (
            trading.withColumn("order", F.xxhash64(F.lit(seed + 1), "doc_id", "size"))
            .withColumn("draw", _draw(seed + 2 + level, "doc_id", "size"))
        )
        done = durable(drawn.groupBy("key", "block").applyInArrow(_settle(last, carry), schema))
        settled = settled.unionByName(done.where("open = 0 or open = 1"))
        if last:
            break
        blocks = math.ceil(blocks / BLOCK_ROWS)
        trading = done.where("open > 0 and open < 1").join(
            planned.select("_source", "key"), F.col("source").eqNullSafe(F.col("_source"))
        ).drop("_source").withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "size"), F.lit(blocks)).cast("int"))
        level += 1
    named = plan.select(F.col("source").alias("_source"), "source_size", "target")
    copies = (F.col("copies") + F.col("open").cast("long")).cast("long")
    return settled.join(named, F.col("source").eqNullSafe(F.col("_source"))).select(
        "row", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
        (copies * F.col("size")).alias("taken"), *carry,
    )
