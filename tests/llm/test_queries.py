"""Queries with SQL against an independent engine, and the pipeline stage by stage on small tables."""

import duckdb
import pytest

import corpus_pipeline
from reviewloom.llm import queries
from reviewloom.llm.oracle import statements

STATEMENTS = statements()


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_same_rows(spark, root, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    df = queries.QUERIES[name](spark, root)
    cursor = con.execute(STATEMENTS[name])
    columns = [d[0] for d in cursor.description]
    order = sorted(columns)
    assert sorted(df.columns) == order
    want = sorted(tuple(repr(row[columns.index(c)]) for c in order) for row in cursor.fetchall())
    assert sorted(tuple(repr(row[c]) for c in order) for row in df.collect()) == want


def test_pipeline(spark, tmp_path):
    text = "the quick brown fox jumps over the lazy dog and runs far away from the noisy town\nevery evening at nine"
    rows = [(i, f"{text} number {i // 2}", "en", f"s{i % 2}", 5) for i in range(20)]
    rows += [(100, None, "en", "s0", 0), (101, "", "en", "s0", 0), (102, "12 34", None, "s1", 5), (None, "une phrase à part", "fr", None, 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if i < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i == 0:
            assert {r.doc_id for r in docs.collect()} == {*range(20), None}
        if i == 2:
            assert docs.count() == len({(r.doc_id, r.text) for r in docs.collect()})
    assert docs.columns == ["doc_id", "n_ids", "ids"] and docs.where("n_ids = 0").count() == 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {r.doc_id for r in docs.collect()}
