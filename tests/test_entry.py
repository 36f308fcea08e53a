"""The driver's contract, with and without the parts that may be absent."""

import sys

import __spark_entry__ as entry

from reviewloom.plans import catalog, oracle


def test_every_statement_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())


def test_without_the_corpus_operators(monkeypatch):
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("reviewloom.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "reviewloom.llm", None)  # as if it were not there
    assert set(entry.queries()) == set(catalog.QUERIES)
    assert set(entry.oracle_sql()) == set(oracle.statements())


def test_smallest_query_runs(spark):
    assert entry.entry(spark).columns == ["user_id", "item_rank", "item_id", "score"]
