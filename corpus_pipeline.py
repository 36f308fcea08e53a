"""From documents to token ids: language, repeated lines, near duplicates, mixing, encoding.

Each stage reads what the one before it kept, as Parquet, and all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm import language, line_dedup, mixing, near_dups, pieces
from reviewloom.llm.queries import MIN_WORDS, MODEL, SIMILAR_PERCENT
from reviewloom.llm.scope import row_keys
from reviewloom.session import checkpoint_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SCORE = 0.4  # mean probability of the text's language, below which no language is accepted
KEYS = ("k1", "k2")


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification: ``lang`` becomes the predicted one; texts without a clear language go.

    That is texts without a letter, null and empty ones among them, and those under LEAST_SCORE.
    """
    found = language.identified(docs.select(*COLUMNS), carry=("text", "source", "n_chars"))
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: later copies of repeated runs are cut from texts; a text of which no word is left goes."""
    found = line_dedup.drop_repeated_lines(docs.select(*COLUMNS), MIN_WORDS, carry=("lang", "source"))
    left = found.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup: of each component of similar texts the row with the smallest doc_id stays, once."""
    keyed = docs.select(*COLUMNS, *row_keys("doc_id", "text"))
    found = near_dups.near_duplicates(keyed, SIMILAR_PERCENT, carry=KEYS)  # five-word shingles
    kept = found.where("kept").select(*KEYS).distinct()
    return keyed.join(kept, list(KEYS)).dropDuplicates(list(KEYS)).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each row is repeated as often as the mix takes it; rows taken no time go.

    Rows equal in doc_id, text and source are taken together from one of them.
    """
    keyed = docs.select(*COLUMNS, *row_keys("doc_id", "text", "source"))
    found = mixing.mixed(keyed, carry=KEYS)
    copies = found.groupBy(*KEYS).agg(F.sum("copies").cast("int").alias("copies")).where("copies > 0")
    taken = keyed.join(copies, list(KEYS)).dropDuplicates(list(KEYS))
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encoding: the piece ids of every text."""
    return pieces.encoded(docs, MODEL)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language identification", identify), ("line dedup", drop_lines), ("near-dedup", drop_near),
    ("mixing", mix), ("encoding", encode),
]

# Language identification is a trained model, mixing draws, and encoding searches: none is an SQL statement.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
