"""Counts, averages, distributions and samples of a review table.

Everything here is a grouped aggregation with map-side partial results, so a key that holds a large
share of the rows costs one partial row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from reviewloom.functions.scalar import rounded, sample_key
from reviewloom.functions.text import words
from reviewloom.operators.numbering import running_total
from reviewloom.operators.quantiles import column_quantiles, quantiles
from reviewloom.session import durable


def distinct_counts(df: DataFrame, cols: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct values of each column, as one row."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[count(F.col(c)).alias(f"n_{c}") for c in cols])


def top_values(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), col).limit(n)


QUARTILES = (0.25, 0.5, 0.75)


def _group_stats(df: DataFrame, value: Column, groups: Sequence[str], rating: str) -> DataFrame:
    """Spread of a value over the groups of each column, and the mean rating, from one scan of ``df``.

    The scan sums by all grouping columns at once; the few numbers per group are written, and the quantile passes read them.
    """
    number = sum(F.when(F.grouping(g) == 0, i).otherwise(0) for i, g in enumerate(groups))
    grouped = df.groupingSets([[g] for g in groups], *groups).agg(
        number.alias("_set"), value.alias("_v"), F.sum(rating).alias("_sum"), F.count(rating).alias("_n")
    )
    values = durable(grouped.select("_set", F.col("_v").cast("double").alias("_v"), "_sum", "_n"))
    found = quantiles(values.select(F.col("_set").alias("series"), F.col("_v").alias("value")), QUARTILES)
    columns = [F.element_at(F.create_map(*[F.lit(x) for i in found for x in (int(i), found[i][k])]), F.col("_set")) if found else F.lit(None).cast("double") for k in range(len(QUARTILES))]
    names = F.array(*[F.lit(g) for g in groups])
    stats = values.groupBy("_set").agg(
        F.min("_v").alias("min_value"), F.max("_v").alias("max_value"), F.round(F.avg("_v"), 6).alias("avg_value"),
        F.round(F.sum("_sum") / F.sum("_n"), 6).alias("global_avg"),
    )
    quarters = [F.round(c, 6).alias(name) for c, name in zip(columns, ("q25", "q50", "q75"), strict=True)]
    return stats.select(
        "min_value", "max_value", "avg_value", *quarters, F.get(names, F.col("_set")).alias("grouped_by"), "global_avg"
    )


def review_count_stats(
    df: DataFrame, counted: str = "review_id", rating: str = "rating", groups: Sequence[str] = ("item_id", "user_id")
) -> DataFrame:
    """Spread of the number of reviews per item and per user."""
    return _group_stats(df, F.count(counted), groups, rating)


def rating_stats(df: DataFrame, rating: str = "rating", groups: Sequence[str] = ("item_id", "user_id")) -> DataFrame:
    """Spread of the mean rating per item and per user."""
    return _group_stats(df, F.avg(rating), groups, rating)


def top_mean_rating(df: DataFrame, by: str, rating: str = "rating", n: int = 10) -> DataFrame:
    return (
        df.groupBy(by).agg(F.round(F.avg(rating), 6).alias("avg_rating")).orderBy(F.desc("avg_rating"), by).limit(n)
    )


def top_review_count(df: DataFrame, by: str, counted: str = "review_id", n: int = 10) -> DataFrame:
    return df.groupBy(by).agg(F.count(counted).alias("n_reviews")).orderBy(F.desc("n_reviews"), by).limit(n)


def mean_ratings(df: DataFrame, key: str = "item_id", counted: str = "review_id", rating: str = "rating") -> DataFrame:
    """Number of reviews and mean rating of each key."""
    return df.groupBy(key).agg(F.count(counted).alias("rating_count"), F.avg(rating).alias("rating_avg"))


def weighted_ratings(means: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Add the mean rating pulled to the mean of all keys, the more so the fewer reviews a key has.

    ``means`` is written once, as the quantile of the counts takes several passes.
    """
    means = durable(means)
    m = F.lit(column_quantiles(means, ["rating_count"], [threshold])["rating_count"][0]).cast("double")
    centre = means.agg(F.avg("rating_avg").alias("c")).scalar()
    n = F.col("rating_count")
    return means.withColumn("rating_weighted", n / (n + m) * F.col("rating_avg") + m / (n + m) * centre)


def top_by(df: DataFrame, by: str, tie: str, n: int = 25) -> DataFrame:
    return df.orderBy(F.desc(by), tie).limit(n)


def text_stats(df: DataFrame, text: str = "review_text") -> DataFrame:
    """Spread of text lengths in characters and in words."""
    return _spread(df.select(F.length(text).alias("chars"), F.size(words(F.col(text))).alias("n_words")))


def _spread(sizes: DataFrame) -> DataFrame:
    """Smallest, largest, mean and median of every column, as one row."""
    sizes = durable(sizes)
    medians = column_quantiles(sizes, sizes.columns, [0.5])
    return sizes.agg(
        *(
            c
            for col in sizes.columns
            for c in (
                F.min(col).alias(f"min_{col}"), F.max(col).alias(f"max_{col}"), F.round(F.avg(col), 6).alias(f"avg_{col}"),
                F.lit(medians[col][0]).cast("double").alias(f"median_{col}"),
            )
        )
    )


def token_stats(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Spread of token counts."""
    return _spread(df.select(F.size(tokens).alias("n_tokens")))


def distinct_tokens(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.explode(words(F.col(text))).alias("token")).agg(F.count_distinct("token").alias("n_tokens"))


def describe(df: DataFrame) -> DataFrame:
    """One row per column: count, distinct values, most frequent value, and moments and quartiles of numbers.

    Mean, standard deviation (of a sample, in two passes) and quartiles are null for columns that hold no numbers.
    """
    plain = durable(df.select(*[F.col(c) for c, t in df.dtypes if not t.startswith(("array", "map", "struct"))]))
    numbers = [f.name for f in plain.schema.fields if isinstance(f.dataType, T.NumericType)]
    quarters = column_quantiles(plain, numbers, QUARTILES) if numbers else {}
    means = plain.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in numbers]).first() if numbers else {}
    parts = []
    for c in plain.columns:
        numeric = c in numbers
        x = F.col(c).cast("double") if numeric else F.lit(None).cast("double")
        centre = means[c] if numeric else None
        q = quarters.get(c, [None] * 3)
        freq = plain.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
        n = F.sum("_n")
        apart = (x - F.lit(centre).cast("double")) ** 2 * F.col("_n")
        parts.append(
            freq.agg(
                F.lit(c).alias("column_name"),
                n.alias("n"),
                F.count(F.lit(1)).alias("n_distinct"),
                F.max_by(F.struct(F.col(c).cast("string").alias("v")), F.struct("_n", c))["v"].alias("top"),
                F.max("_n").alias("top_freq"),
                F.round(F.lit(centre).cast("double"), 6).alias("avg"),
                F.round(F.sqrt(F.try_divide(F.sum(apart), n - 1)), 6).alias("sd"),
                F.min(x).alias("min"),
                *[rounded(F.lit(v).cast("double")).alias(name) for v, name in zip(q, ("q25", "q50", "q75"), strict=True)],
                F.max(x).alias("max"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def histogram(df: DataFrame, value: Column, width: float | None = None, bins: int | None = None) -> DataFrame:
    """(bin, bin_start, n) with a fixed bin width, or with equal bins between minimum and maximum."""
    data = df.select(value.cast("double").alias("v")).where(F.col("v").isNotNull())
    low = F.lit(0.0)
    if width is None:
        if not bins:
            raise ValueError("give a bin width or a number of bins")
        low = data.agg(F.min("v").alias("v")).scalar()
        high = data.agg(F.max("v").alias("v")).scalar()
        step = (high - low) / F.lit(float(bins))
        slot = F.when(step > 0, F.least(F.floor((F.col("v") - low) / step), F.lit(bins - 1))).otherwise(F.lit(0))
    else:
        step = F.lit(float(width))
        slot = F.floor(F.col("v") / step)
    return (
        data.groupBy(slot.cast("bigint").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("bin", F.round(low + F.col("bin") * step, 6).alias("bin_start"), "n")
    )


def long_tail(df: DataFrame, key: str = "item_id", counted: str = "review_id", q: float = 0.8) -> DataFrame:
    """How many items have how many reviews, how many are at least as popular, and the quantile.

    The curve of counts in falling order, stored as one row per distinct count.
    """
    counts = durable(df.groupBy(key).agg(F.count(counted).alias("n_reviews")).select("n_reviews"))
    curve = counts.groupBy("n_reviews").agg(F.count(F.lit(1)).alias("n_items"))
    upto = running_total(curve, "n_items", "items_at_least", F.desc("n_reviews"))
    cut = F.lit(column_quantiles(counts, ["n_reviews"], [q])["n_reviews"][0]).cast("double")
    return upto.select("n_reviews", "n_items", "items_at_least", F.round(cut, 6).alias("quantile"))


def length_slice(df: DataFrame, key: str, text: str, start: int = 500, n: int = 100) -> DataFrame:
    """Rows ``start`` to ``start + n`` in order of text length."""
    return df.orderBy(F.length(text), key).offset(start).limit(n)


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Repeatable random sample of ``n`` rows: the first by a seeded hash of the key."""
    return df.orderBy(sample_key(F.col(key), seed), key).limit(n)


def sample_users(df: DataFrame, n: int, seed: int = 42, pinned: Sequence = ()) -> DataFrame:
    """``n`` distinct users, plus the pinned ones."""
    users = df.select("user_id").distinct()
    drawn = sample_rows(users, "user_id", n, seed)
    if not pinned:
        return drawn
    return drawn.unionByName(users.where(F.col("user_id").isin(list(pinned)))).distinct()


def best_per_group(df: DataFrame, group: str, by: str, tie: str, n: int) -> DataFrame:
    """The n rows of each group with the highest ``by``; ``place`` counts from 0."""
    order = W.partitionBy(group).orderBy(F.desc(by), tie)
    ranked = df.withColumn("place", F.row_number().over(order) - 1)
    return ranked.where(F.col("place") < n)
