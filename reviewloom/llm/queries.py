"""Named queries on whole tables: (spark, folder) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm import (
    exact_dups,
    hmm,
    language,
    line_dedup,
    mixing,
    near_dups,
    pieces,
    secrets,
    signature_trees,
    topk,
    variants,
    warc,
    whitening,
)
from reviewloom.session import checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MODEL = "/opt/tokenizers/piece_bpe_32k.model"  # a public tokenizer's vocabulary
QUERY_EVERY, NEAREST = 50, 5
SIMILAR_PERCENT = 80
SIMILAR_WIDTH = 2
JOIN_PERCENT, JOIN_WIDTH = 90, 3
MIN_WORDS = 4  # words of a run of lines from which later copies are deleted


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


@query
def op1_topk(spark: SparkSession, root: str) -> DataFrame:
    """The five best inner products of every fiftieth vector with all others."""
    rows = topk.quantised(_table(spark, root, "embeddings"), "vec_id", "embedding")
    return topk.top_k(rows.where(F.col("vec_id") % QUERY_EVERY == 0), rows, NEAREST)


@query
def op2_near_dups(spark: SparkSession, root: str) -> DataFrame:
    return near_dups.near_duplicates(_table(spark, root, "documents"), SIMILAR_PERCENT, width=SIMILAR_WIDTH)


@query
def op3_language(spark: SparkSession, root: str) -> DataFrame:
    return language.identified(_table(spark, root, "documents"))


@query
def op4_secrets(spark: SparkSession, root: str) -> DataFrame:
    found = secrets.secret_spans(_table(spark, root, "documents"))
    spans = F.col("spans")

    def number(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *(number(kind) for kind in secrets.KINDS),
        F.sha2(secrets.listed(spans, secrets.KINDS[:3]), 256).alias("base_sha256"),
        secrets.listed(spans).alias("spans"),
    )


@query
def op5_exact_dups(spark: SparkSession, root: str) -> DataFrame:
    return exact_dups.exact_duplicates(_table(spark, root, "documents"))


@query
def op6_pieces(spark: SparkSession, root: str) -> DataFrame:
    """Ids of every text, and whether decoding them gives the text again."""
    return pieces.encoded(_table(spark, root, "documents"), MODEL, check=True)


@query
def op7_warc(spark: SparkSession, root: str) -> DataFrame:
    """Pages written as archives in the shared folder, then read back."""
    path = f"{checkpoint_dir(spark)}/archives/{uuid.uuid4().hex}"
    warc.write_archives(_table(spark, root, "pages"), path)
    return warc.read_archives(spark, path, payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query
def op8_line_dedup(spark: SparkSession, root: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(_table(spark, root, "documents"), MIN_WORDS)


@query
def op9_hmm(spark: SparkSession, root: str) -> DataFrame:
    return hmm.scored(_table(spark, root, "documents"))


@query
def op10_mixing(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mixed(_table(spark, root, "documents")).drop("row", "copies")


@query
def op11_variants(spark: SparkSession, root: str) -> DataFrame:
    return variants.spelling_variants(_table(spark, root, "documents"))


@query
def op12_ngram_join(spark: SparkSession, root: str) -> DataFrame:
    """Texts linked by nine tenths of their three-word shingles."""
    return signature_trees.linked(_table(spark, root, "documents"), JOIN_PERCENT, JOIN_WIDTH)


@query
def op13_whitening(spark: SparkSession, root: str) -> DataFrame:
    return whitening.whitened(whitening.quantised(_table(spark, root, "embeddings")))
