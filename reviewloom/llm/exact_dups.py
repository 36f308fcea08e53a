"""Exact duplicates with frequent texts taken out before the shuffle. Column expressions only.

A frequent-items sketch (Misra-Gries counters; Spark's ``approx_top_k`` aggregate, merged across partitions)
names the digests that may be frequent. Their true counts and winners are then aggregated from all rows, which sums
before it shuffles, and are broadcast: at most ``FREQUENT`` rows. Rows of those digests are settled where they
are read. What remains has no digest that many rows share, and takes the ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.session import durable

FREQUENT, COUNTERS = 2_000, 16_000  # digests taken as frequent, and counters of the sketch
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without blanks, tabs, line feeds, vertical tabs, form feeds and carriage returns; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def _settled(rows: DataFrame) -> DataFrame:
    """Size and winner of each digest: most code points first, then the smallest id, ids before null."""
    return rows.groupBy("text_sha256").agg(
        F.count("*").alias("group_size"),
        F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("w"),
    ).select("text_sha256", "group_size", F.col("w.doc_id").alias("keep_id"), (-F.col("w.less")).alias("keep_chars"))


def exact_duplicates(docs: DataFrame, frequent: int = FREQUENT, counters: int = COUNTERS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs`` (doc_id, text).

    Texts are equal if their normalised forms are. Of equal texts the one with the most code points stays, then
    the smallest doc_id. Null, empty and blank texts are equal to each other. A row without doc_id takes
    part and stays only where all its equals lack one too and none is longer; keep_id is then null. Rows
    that repeat the winner's doc_id and length are all marked kept. Other columns are not read.
    """
    rows = durable(
        docs.select(
            "doc_id",
            F.sha2(normalised(F.col("text")), 256).alias("text_sha256"),
            F.coalesce(F.char_length("text"), F.lit(0)).alias("n_chars"),
        )
    )
    named = rows.agg(F.expr(f"approx_top_k(text_sha256, {frequent}, {counters})").alias("top"))
    named = named.select(F.explode("top").alias("top")).where("top.count > 1")
    named = durable(named.select(F.col("top.item").alias("text_sha256")))
    hot = durable(_settled(rows.join(F.broadcast(named), "text_sha256", "left_semi")))
    settled = rows.join(F.broadcast(hot), "text_sha256")
    cold = rows.join(F.broadcast(named), "text_sha256", "left_anti")
    shuffled = cold.join(_settled(cold), "text_sha256")
    out = settled.unionByName(shuffled)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
