"""Repeated runs of lines across documents, by ranks of a suffix array. Column expressions only.

The non-blank lines of a document are a sequence of line ids; all sequences are laid out one after the other, with a gap
between documents, so that a line is one number, its place. Prefix doubling ranks the suffixes by their first 1, 2, 4, ...
lines: the rank of 2n lines comes from the ranks of the first and the next n lines, and keeps their order. Ranks are given by
a distributed sort of the distinct pairs, to prefixes that occur twice at least; doubling ends when none of them does, so it
covers the longest repeated run.

Suffixes that share their first n lines are an interval of the suffix array in which the longest common prefix is n or
more. An interval is named by n and its earliest place. Every place goes down these intervals from the widest step to
a single line: it enters the interval of n + 2**k lines if that one has an earlier place. Where it stops, n is the length of
the longest run that starts there and has an earlier copy. The runs that are not part of the run of the line before are
maximal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewloom.llm.scope import row_keys
from reviewloom.session import durable

BLANKS = " \t\n\x0b\x0c\r"
KEY = ("k1", "k2")
HEAVY, HEAVY_KEYS = 1_000, 100_000  # a key is heavy from so many rows, and from so large a share of all that few can be


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _sequences(docs: DataFrame) -> DataFrame:
    """One row per non-blank line: its place among them (seq), its place in the text (at), digest and words."""
    listed = F.filter(
        F.transform(lines_of(F.col("text")), lambda x, i: F.struct(i.alias("at"), F.btrim(x, F.lit(BLANKS)).alias("line"))),
        lambda x: x["line"] != "",
    )
    rows = docs.select("doc_id", *row_keys("doc_id", "text"), F.posexplode(listed).alias("seq", "x")).select(
        "doc_id", *KEY, "seq", F.col("x.at").alias("at"),
        F.unhex(F.substring(F.sha2("x.line", 256), 1, 32)).alias("id"),
        F.regexp_count("x.line", F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
    )
    return rows


def _ranked(repeated: DataFrame, *by: str) -> DataFrame:
    """An order-preserving rank for each row: range partitions, sorted, then numbered in place."""
    ordered = repeated.repartitionByRange(*by).sortWithinPartitions(*by)
    return durable(ordered.withColumn("rank", F.monotonically_increasing_id()))


def _sizes(keyed: DataFrame) -> tuple[int | None, int | None]:
    """Rows of all keys and of the largest one; None if there is no key."""
    return tuple(keyed.agg(F.sum("copies"), F.max("copies")).first())


def _joined(
    rows: DataFrame, keyed: DataFrame, on: list[str], how: str = "inner", sizes: tuple[int | None, int | None] | None = None
) -> DataFrame:
    """``rows`` joined with a written table of one row per key, which says how many rows a key has (copies).

    Rows of heavy keys, of which there are HEAVY_KEYS at most, are joined where they lie, by a broadcast.
    """
    total, most = sizes or _sizes(keyed)
    heavy = max(HEAVY, (total or 0) // HEAVY_KEYS)
    if (most or 0) <= heavy:
        return rows.join(keyed.drop("copies"), on, how)
    few = keyed.where(F.col("copies") > heavy).drop("copies")
    rest = rows.join(F.broadcast(few.select(*on)), on, "left_anti")
    others = rest.join(keyed.where(F.col("copies") <= heavy).drop("copies"), on, how)
    return rows.join(F.broadcast(few), on).unionByName(others)


def _bases(extent: DataFrame, *order: Column) -> DataFrame:
    """(k1, k2, base): the places that the documents before take, in the given order.

    Documents are dealt out by ranges of the order; the window over all holds one row per range.
    """
    dealt = durable(extent.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    totals = dealt.groupBy("part").agg(F.sum("extent").alias("total"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    inside = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    base = F.coalesce(F.sum("extent").over(inside), F.lit(0)) + F.col("offset")
    return dealt.join(F.broadcast(offsets), "part").select(*KEY, base.alias("base"))


def _active(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, place, at, words, rank): lines that occur twice at least.

    Places follow doc_id (null last), then the order in the text; rows equal in doc_id and text are one document.
    """
    lines = durable(_sequences(docs))
    repeated = lines.groupBy("id").agg(F.count("*").alias("copies")).where("copies > 1")
    rows = durable(_joined(lines, _ranked(repeated, "id"), ["id"]).drop("id"))
    extent = rows.groupBy("doc_id", *KEY).agg((F.max("seq") + 2).cast("long").alias("extent"))
    bases = _bases(extent, F.col("doc_id").isNull(), F.col("doc_id"), *(F.col(k) for k in KEY))
    placed = rows.join(bases, list(KEY)).withColumn("place", F.col("base") + F.col("seq"))
    return durable(placed.drop("base", "seq").dropDuplicates(["place"]))


def suffix_ranks(first: DataFrame) -> list[DataFrame]:
    """Level k: (place, rank) of the suffixes whose first 2**k lines occur at two places or more; ``first`` is level 0."""
    levels = [first]
    while True:
        step = 1 << (len(levels) - 1)
        ahead = levels[-1].select((F.col("place") - step).alias("place"), F.col("rank").alias("b"))
        pairs = durable(levels[-1].withColumnRenamed("rank", "a").join(ahead, "place"))
        copies = pairs.groupBy("a", "b").agg(F.count("*").alias("copies")).where("copies > 1")
        ranks = _ranked(copies, "a", "b")
        sizes = _sizes(ranks)
        if sizes[0] is None:
            return levels
        levels.append(durable(_joined(pairs, ranks, ["a", "b"], sizes=sizes).select("place", "rank")))


def earlier_copies(levels: list[DataFrame]) -> DataFrame:
    """(place, n, earliest): lines of the longest run that starts at a place and also at an earlier one, and the first such.

    A member of an interval that is not its earliest place has a run of that length, so of those that are tried at one step
    only the earliest place of the interval they are in can be missing; it is added.
    """
    within = ["n", "earliest", "rank"]
    found = None
    for k in reversed(range(len(levels))):
        level = levels[k]
        if found is None:
            tried = level.select("place", F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("earliest"), "rank")
        else:
            fresh = level.join(found.select("place"), "place", "left_anti").select(
                "place", F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("earliest"), "rank"
            )
            heads = found.select("n", "earliest").distinct().select(F.col("earliest").alias("place"), "n", "earliest")
            ahead = level.select(F.col("place").alias("next"), "rank")
            members = found.unionByName(heads).withColumn("next", F.col("place") + F.col("n"))
            tried = members.join(ahead, "next", "left").drop("next").unionByName(fresh)
        tried = durable(tried)
        intervals = durable(
            tried.where("rank is not null").groupBy(*within).agg(F.min("place").alias("least"), F.count("*").alias("copies"))
            .where("copies > 1")
        )
        longer = _joined(tried.where("rank is not null"), intervals, within, "left").select(
            "place",
            F.when(F.col("least") < F.col("place"), F.col("n") + (1 << k)).otherwise(F.col("n")).alias("n"),
            F.when(F.col("least") < F.col("place"), F.col("least")).otherwise(F.col("earliest")).alias("earliest"),
        )
        # a head is no member of its own interval; what has no run yet is tried again
        ended = tried.where("rank is null").drop("rank")
        found = durable(longer.unionByName(ended).where("n > 0 and earliest < place"))
    return found


def _counted(active: DataFrame, min_words: int) -> DataFrame:
    """The lines, with the run that starts there if it has ``min_words`` words: (n, earliest, run_words), else null."""
    copies = earlier_copies(suffix_ranks(active.select("place", "rank")))
    within = W.partitionBy(*KEY).orderBy("place")
    # every line has a word, so the first min_words lines of a run decide
    ahead = F.collect_list("words").over(within.rowsBetween(0, min_words - 1))
    rows = active.drop("rank").join(copies, "place", "left").withColumn("_ahead", ahead)
    words = F.aggregate(F.slice("_ahead", 1, F.least("n", F.lit(min_words)).cast("int")), F.lit(0), lambda acc, x: acc + x)
    counts = F.col("n").isNotNull() & (words >= min_words)
    return rows.select(
        "doc_id", *KEY, "place", "at", "words",
        F.when(counts, F.col("n")).alias("n"), F.when(counts, F.col("earliest")).alias("earliest"),
    )


def repeated_lines(docs: DataFrame, min_words: int = 4) -> DataFrame:
    """(k1, k2, at): lines that belong to a later copy of a repeated run of at least ``min_words`` words.

    Copies are ordered by doc_id (null last) and place.
    """
    if min_words < 1:
        raise ValueError("min_words starts at 1")
    reach = F.max(F.col("place") + F.col("n")).over(
        W.partitionBy(*KEY).orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    )
    rows = _counted(_active(docs), min_words).withColumn("reach", reach)
    return rows.where(F.col("reach") > F.col("place")).select(*KEY, "at")


def repeated_runs(docs: DataFrame, min_words: int = 4) -> DataFrame:
    """(doc_id, at, n_lines, from_doc_id, from_at): every maximal run that also occurs at an earlier place.

    ``at`` is the run's first line in its text (from 0, blank lines counted), ``n_lines`` its non-blank lines, and the
    other two name its earliest copy. A run that ends where the run of the line before ends, is part of that one and not
    listed. Rows equal in doc_id and text are one document; null and empty texts have no runs.
    """
    if min_words < 1:
        raise ValueError("min_words starts at 1")
    active = _active(docs.select("doc_id", "text"))
    rows = _counted(active, min_words)
    order = W.partitionBy(*KEY).orderBy("place")
    before = F.max(F.col("place") + F.col("n")).over(order.rowsBetween(W.unboundedPreceding, -1))
    maximal = rows.withColumn("_before", before).where(
        F.col("n").isNotNull() & (F.col("_before").isNull() | (F.col("place") + F.col("n") > F.col("_before")))
    )
    first = active.select(F.col("place").alias("earliest"), F.col("doc_id").alias("from_doc_id"), F.col("at").alias("from_at"))
    return maximal.join(first, "earliest").select(
        "doc_id", F.col("at").cast("long").alias("at"), F.col("n").alias("n_lines"),
        "from_doc_id", F.col("from_at").cast("long").alias("from_at"),
    )


def drop_repeated_lines(docs: DataFrame, min_words: int = 4, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, n_lines, n_removed): every row of ``docs`` (doc_id, text), later copies of runs deleted.

    Lines are compared without blanks at their ends; blank lines belong to no run, do not part one, and stay. Null
    text stays null and has no lines; an empty text is one blank line. A text can lose all its lines; it is then
    empty unless blank lines are left. Rows equal in doc_id and text are one document and get the same result;
    rows without doc_id come after all others. Columns named in ``carry`` come along, others are not read.
    """
    docs = docs.select("doc_id", "text", *carry)
    gone = repeated_lines(docs, min_words).groupBy(*KEY).agg(F.collect_list("at").alias("gone"))
    lines = lines_of(F.col("text"))
    places = F.sequence(F.lit(0), F.size("_lines") - 1)
    kept = F.transform(F.array_except(places, F.col("gone")), lambda i: F.get("_lines", i))
    # the lines are split for texts that lose some, the others pass as they are
    return (
        docs.select("*", *row_keys("doc_id", "text")).join(gone, list(KEY), "left")
        .withColumn("_lines", lines)
        .select(
            "doc_id",
            F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
            F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("n_lines"),
            F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
            *carry,
        )
    )
