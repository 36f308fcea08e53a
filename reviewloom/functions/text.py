"""Review text cleaning as column expressions: no Python runs per row."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from reviewloom.session import durable

# English contractions in lower case, replaced as plain text in this order.
CONTRACTIONS = (
    ("’", "'"),
    ("won't", "will not"),
    ("can't", "cannot"),
    ("shan't", "shall not"),
    ("ain't", "are not"),
    ("let's", "let us"),
    ("y'all", "you all"),
    ("n't", " not"),
    ("'re", " are"),
    ("'ve", " have"),
    ("'ll", " will"),
    ("'m", " am"),
)
# Endings that stand for a verb after these words only, (pattern, replacement).
# Written in the subset of regular expressions that Java and RE2 read alike.
VERB_ENDINGS = (
    ("(^|[^a-z])(it|he|she|that|there|here|what|who|where|how|when|why)'s", "$1$2 is"),
    ("(^|[^a-z])(i|you|he|she|it|we|they|there|that|who)'d", "$1$2 would"),
)

# The single-word entries of Spark's own English stop word list.
STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
    she her hers herself it its itself they them their theirs themselves what which who whom this
    that these those am is are was were be been being have has had having do does did doing a an
    the and but if or because as until while of at by for with about against between into through
    during before after above below to from up down in out on off over under again further then
    once here there when where why how all any both each few more most other some such no nor not
    only own same so than too very s t can will just don should now cannot could ought would
    """.split()
)

# Token length limits.
TOKEN_MIN, TOKEN_MAX = 2, 15

LINE_BREAKS = r"[\r\n]+"
NON_LETTERS = "[^a-z]+"


def expand_contractions(text: Column) -> Column:
    """Expand contractions of a lower-case text."""
    for short, full in CONTRACTIONS:
        text = F.replace(text, F.lit(short), F.lit(full))
    for pattern, replacement in VERB_ENDINGS:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def join_lines(text: Column) -> Column:
    return F.regexp_replace(text, LINE_BREAKS, " ")


def letters_only(text: Column) -> Column:
    """One space for every run of characters of a lower-case text that are not ASCII letters."""
    return F.regexp_replace(text, NON_LETTERS, " ")


def words(text: Column) -> Column:
    """Whitespace-separated words, no empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def drop_stop_words(tokens: Column, stop_words: Iterable[str] = STOP_WORDS) -> Column:
    stop = list(stop_words)
    return F.filter(tokens, lambda w: ~w.isin(stop)) if stop else tokens


def keep_token_lengths(tokens: Column, shortest: int = TOKEN_MIN, longest: int = TOKEN_MAX) -> Column:
    return F.filter(tokens, lambda w: F.length(w).between(shortest, longest))


def normalise(text: Column) -> Column:
    """Everything that happens to a text before it is cut into tokens.

    Lower case comes first, which changes no result and lets the later steps match plain text. Line
    breaks are not letters, so they need no step of their own here. Texts without an apostrophe skip the
    contractions; the test looks at the plain column, so nothing is computed twice.
    """
    lower = F.lower(text)
    has_short = text.contains("'") | text.contains("’")
    return letters_only(F.when(has_short, expand_contractions(lower)).otherwise(lower))


def final_tokens(tokens: Column, stop_words: Iterable[str] = STOP_WORDS) -> Column:
    """Stop word and length filters in one pass over the array."""
    stop = list(stop_words)

    def wanted(word: Column) -> Column:
        fits = F.length(word).between(TOKEN_MIN, TOKEN_MAX)
        return fits & ~word.isin(stop) if stop else fits

    return F.filter(tokens, wanted)


def preprocess(text: Column, stop_words: Iterable[str] = STOP_WORDS) -> Column:
    """Cleaned text as one space-joined string, without lemmas."""
    return F.array_join(final_tokens(F.split(normalise(text), " "), stop_words), " ")


def lemmatise(df: DataFrame, tokens: str, key: str, lemmas: DataFrame) -> DataFrame:
    """Replace each token by its lemma where the dictionary ``(form, lemma)`` has one.

    Only the forms of a key that have a lemma are joined and gathered; tokens stay in their rows, which are shuffled once.
    Rows that share a key get the words of all of them, by position; a row without a key is left as it is.
    """
    known = durable(lemmas.groupBy("form").agg(F.min("lemma").alias("lemma")).dropna())
    keyed = df.where(F.col(key).isNotNull())
    forms = keyed.select(key, F.explode(F.array_distinct(tokens)).alias("form"))
    found = forms.join(known, "form").groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("form", "lemma"))).alias("_lemmas"))
    replaced = F.transform(tokens, lambda w: F.coalesce(F.try_element_at("_lemmas", w), w))
    of_key = F.collect_list("_own").over(W.partitionBy(key))
    placed = F.transform("_all", lambda own: F.transform(own, lambda w, i: F.struct(i.alias("pos"), w.alias("word"))))
    together = F.transform(F.array_sort(F.flatten(placed)), lambda s: s["word"])
    merged = F.when(F.size("_all") == 1, F.col("_all")[0]).otherwise(together)
    done = (
        keyed.join(found, key, "left")
        .withColumn("_own", F.when(F.col("_lemmas").isNull(), F.col(tokens)).otherwise(replaced))
        .withColumn("_all", of_key)
        .withColumn("_merged", merged)
        .withColumn(tokens, F.when(F.size("_merged") > 0, F.col("_merged")).otherwise(F.col(tokens)))
    )
    return done.select(df.columns).unionByName(df.where(F.col(key).isNull()))


def computed_once(col: Column) -> Column:
    """The same value behind a generator, so that filters on it do not pull copies of a costly expression
    below themselves."""
    return F.explode_outer(F.array(col))


def preprocess_reviews(
    df: DataFrame,
    text: str = "review_text",
    out: str = "processed_text",
    key: str = "review_id",
    lemmas: DataFrame | None = None,
    stop_words: Iterable[str] = STOP_WORDS,
) -> DataFrame:
    """Add the cleaned text. With a lemma dictionary the tokens make one round trip through a join."""
    if lemmas is None:
        return df.select("*", computed_once(preprocess(F.col(text), stop_words)).alias(out))
    df = lemmatise(df.withColumn("_tokens", words(normalise(F.col(text)))), "_tokens", key, lemmas)
    return df.withColumn(out, F.array_join(final_tokens(F.col("_tokens"), stop_words), " ")).drop("_tokens")
