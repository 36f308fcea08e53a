"""Row counts of a stage, gathered while its rows pass: how many came in, what each rule dropped, how many went on.

Counts are observed metrics of the job that writes the result, so nothing is read twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions.scalar import review_date
from reviewloom.operators.clean import TITLE_MARKUP, blank_to_null, drop_markup_titles
from reviewloom.operators.split import split_train_test
from reviewloom.schemas import RAW_REVIEW_FIELDS, RAW_REVIEWS, SPLIT_RATIO
from reviewloom.sources.readers import read_records

ROWS = "rows"


class Ledger:
    """Counts by step, in the order in which the steps were noted."""

    def __init__(self):
        self._noted: dict[str, Observation] = {}

    def note(self, df: DataFrame, step: str, **conditions: Column) -> DataFrame:
        """``df`` unchanged; when it has been computed, the ledger knows its rows and how many meet each condition."""
        if step in self._noted:
            raise ValueError(f"step {step!r} is noted already")
        seen = self._noted[step] = Observation()
        counts = [F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in conditions.items()]
        return df.observe(seen, F.count(F.lit(1)).alias(ROWS), *counts)

    def counts(self) -> dict[str, dict[str, int]]:
        """Counts of all steps. Waits for the job that computes them, so call it after an action on the last step."""
        return {step: dict(seen.get) for step, seen in self._noted.items()}

    def table(self, spark: SparkSession) -> DataFrame:
        """(step, measure, n)."""
        rows = [(step, measure, int(n)) for step, found in self.counts().items() for measure, n in found.items()]
        return spark.createDataFrame(rows, "step string, measure string, n long")


def read_reviews(spark: SparkSession, path: str, ledger: Ledger) -> tuple[DataFrame, DataFrame]:
    """Reviews of a raw dump with ``review_date`` parsed, and the lines that could not be read; both are noted.

    A date that does not parse is null; so is a missing one, which does not count as unparsed.
    """
    rows, rejects = read_records(spark, path, RAW_REVIEWS)
    rows = rows.select(*[F.col(a).alias(b) for a, b in RAW_REVIEW_FIELDS.items()])
    rows = rows.withColumn("review_date", review_date(F.col("review_time")))
    unparsed = F.col("review_time").isNotNull() & F.col("review_date").isNull()
    return ledger.note(rows, "reviews", dates_not_parsed=unparsed), ledger.note(rejects, "rejected lines")


def prepare(
    reviews: DataFrame, meta: DataFrame, required: Sequence[str], ledger: Ledger, key: str = "item_id",
    texts: DataFrame | None = None, text_key: str = "doc_id",
) -> DataFrame:
    """The merge of ``clean.merge_reviews``, with every step noted: items, items with a broken title, joined rows, rows
    that lack each required value, rows kept.

    ``texts`` that reviews name by ``text_key`` are joined last, in order of that key: no shuffle carries a text more than
    once, and copies of a text are written side by side, where they take little room.
    """
    broken = F.col("title").contains(TITLE_MARKUP)
    items = drop_markup_titles(ledger.note(meta, "items", broken_title=broken))
    merged = items.join(reviews, key)
    if texts is not None:
        merged = merged.join(texts.hint("merge"), text_key)
    merged = blank_to_null(merged)
    merged = ledger.note(merged, "joined", **{f"no_{c}": F.col(c).isNull() for c in required})
    return ledger.note(merged.dropna(subset=list(required)), "kept")


def split(reviews: DataFrame, ledger: Ledger, ratio: float = SPLIT_RATIO) -> tuple[DataFrame, DataFrame]:
    """Train and test rows, noted."""
    train, test = split_train_test(reviews, ratio)
    return ledger.note(train, "train"), ledger.note(test, "test")
