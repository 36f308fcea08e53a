"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewloom.schemas import RATING_MAX, RATING_MIN

REVIEW_TIME_FORMAT = "M d, yyyy"  # fixed value: "07 9, 2012"

# Fixed values of the repeatable pair hash behind the random baseline.
HASH_PRIME = 2147483647
HASH_USER, HASH_ITEM, HASH_MIX = 16807, 48271, 69621


def review_date(text: Column) -> Column:
    """Parse the dump's date form; null where it does not parse."""
    return F.try_to_date(text, REVIEW_TIME_FORMAT)


def empty_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def clip_rating(col: Column) -> Column:
    return F.greatest(F.lit(RATING_MIN), F.least(F.lit(RATING_MAX), col))


def rounded(col: Column, digits: int = 6) -> Column:
    """Rounded without negative zero."""
    return F.round(col, digits) + F.lit(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where one has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def unit(a: Column) -> Column:
    """The array scaled to length 1; an all-zero array stays as it is.

    Array and length are variables of a function over one entry, or the length would be taken again for every place.
    """

    def scaled(v: Column, size: Column) -> Column:
        return F.when(size > 0, F.transform(v, lambda x: x / size)).otherwise(v)

    def of(v: Column) -> Column:
        return F.get(F.transform(F.array(norm(v)), lambda size: scaled(v, size)), F.lit(0))

    return F.get(F.transform(F.array(a), of), F.lit(0))


def vector_scale(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def sample_key(col: Column, seed: int = 42) -> Column:
    """Order key of a repeatable random sample; the same in every engine that has md5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), col.cast("string")).cast("binary"))


def hash_code(col: Column, dtype: str) -> Column:
    """Non-negative number below HASH_PRIME for an id of any type."""
    number = col if dtype in ("bigint", "int", "smallint", "tinyint") else F.xxhash64(col)
    return F.pmod(number.cast("bigint"), F.lit(HASH_PRIME))


def seeded_normal(key: Column, position: Column, seed: int, sd: float) -> Column:
    """Normal draw that depends on the key and the position alone (Box-Muller)."""
    def uniform(salt: int) -> Column:
        bits = F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), key, position), F.lit(1 << 40))
        return (bits + 0.5) / F.lit(float(1 << 40))

    return F.lit(sd) * F.sqrt(-2.0 * F.ln(uniform(1))) * F.cos(2.0 * F.pi() * uniform(2))
