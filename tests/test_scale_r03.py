"""What the tasks of a step hold, score and hand on, for tables larger than a test can hold."""

import tracemalloc

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from reviewloom.functions import text
from reviewloom.llm import signature_trees
from reviewloom.operators import accounting, grid, index, paragraph, reshape, topics


def cell_rows(users, items, pairs, at_once):
    """Rows of one cell in the order in which they come."""
    rows = [(0, u, None, v) for u, v in users] + [(1, u, i, None) for u, i in pairs] + [(2, None, i, v) for i, v in items]
    kind, user, item, vec = zip(*rows)
    table = pa.table({"kind": pa.array(kind, pa.int32()), "user_id": pa.array(user, pa.int64()), "item_id": pa.array(item, pa.int64()), "vec": pa.array(vec, pa.list_(pa.float64()))})
    return iter(table.to_batches(max_chunksize=at_once))


def test_streamed_items_give_the_lists_of_all_pairs(monkeypatch):
    monkeypatch.setattr(grid, "FIRST_ITEMS", 8)
    monkeypatch.setattr(grid, "FIRST_PER_PLACE", 1)
    monkeypatch.setattr(grid, "BLOCK_ROWS", 32)
    monkeypatch.setattr(grid, "TILE", 200)
    rng = np.random.default_rng(3)
    u, v = rng.integers(-2, 3, (30, 4)).astype(float), rng.integers(-2, 3, (150, 4)).astype(float)  # many scores tie
    pairs = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, 30, 200), rng.integers(0, 150, 200))}, key=lambda p: p[::-1])
    rows = lambda: cell_rows([(i, x.tolist()) for i, x in enumerate(u)], [(i, x.tolist()) for i, x in enumerate(v)], pairs, 23)
    scores = u @ v.T
    for mark in (False, True):
        masked = scores.copy()
        if not mark:
            masked[tuple(zip(*pairs))] = -np.inf
        for clip, ceiling in ((None, np.inf), ((-3.0, 3.0), 3.0)):
            wanted = np.clip(masked, *clip) if clip else masked
            if clip and not mark:
                wanted[tuple(zip(*pairs))] = -np.inf
            found = pa.Table.from_batches(grid._cell(grid.dot_scorer(clip=clip), 10, 6, ceiling, mark)(rows())).to_pylist()
            for a in range(30):
                own = [(r["item_id"], r["score"]) for r in found if r["user_id"] == a]
                best = sorted(range(150), key=lambda i: (-wanted[a, i], i))[:10]
                assert own == [(i, wanted[a, i]) for i in best]
            if mark:
                assert all(r["marked"] == ((r["user_id"], r["item_id"]) in set(pairs)) for r in found)


def test_full_lists_are_not_scored_again():
    seen = []

    def scorer(users, items):
        seen.append(users.shape[0] * items.shape[0])
        return np.clip(users @ items.T, 1.0, 5.0)

    users, items = [(i, [9.0]) for i in range(5)], [(i, [1.0]) for i in range(20_000)]
    found = pa.Table.from_batches(grid._cell(scorer, 10, 6, 5.0, False)(cell_rows(users, items, [], 10_000)))
    assert found["item_id"].to_pylist() == [*range(10)] * 5
    assert sum(seen) <= 5 * grid.FIRST_ITEMS  # 100,000 pairs before


def test_copies_between_the_blocks():
    """900,000 users with 200 of 1,200,000 items each: lists came from 19 item blocks, 82 GB of them."""
    user_blocks, item_blocks = grid.block_counts(900_000, 1_200_000, 12, 200)
    copied = user_blocks * 1_200_000 * grid.VECTOR_BYTES + item_blocks * 900_000 * (grid.VECTOR_BYTES + 200 * grid.LISTED_BYTES)
    assert copied < 20e9
    assert 900_000 / user_blocks * (grid.VECTOR_BYTES + 200 * grid.HELD_BYTES) <= 2 * grid.BLOCK_BYTES
    assert grid.block_counts(1, 1_200_000, 12, 5)[1] > 1  # few users: the items are shared out


def test_index_hands_on_few_copies_at_a_time():
    """10,000 vectors with 300 lists each came in one batch of 3,000,000 vectors, and all scores of a list at once."""
    vecs = np.random.default_rng(1).normal(size=(2_000, 8))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, vecs.size + 1, 8), pa.int32()), pa.array(vecs.reshape(-1)))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(2_000)), lists], names=["user_id", "vec"])
    found = list(index._filed(vecs[:300], "user_id", 300)(iter([batch])))
    assert max(b.num_rows for b in found) <= index.COPIES_AT_ONCE
    assert sum(b.num_rows for b in found) == 600_000


def test_scores_of_a_list_are_held_in_tiles():
    n = 3_000
    vecs = np.random.default_rng(2).normal(size=(2 * n, 4))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, vecs.size + 1, 4), pa.int32()), pa.array(vecs.reshape(-1)))
    ids = pa.array(np.arange(2 * n))
    cell = pa.table({"is_query": pa.array(np.arange(2 * n) < n), "user_id": ids, "item_id": ids, "vec": lists})
    tracemalloc.start()
    got = index._scored(2, 6)(cell)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 140e6  # 72 MB of scores and copies of them before
    scores = vecs[:n] @ vecs[n:].T
    assert got["item_id"].to_numpy()[::2].tolist() == (scores.argmax(axis=1) + n).tolist()


def test_whole_texts_shuffle_no_text_that_is_alone(spark):
    rows = [(i, f"u{i % 40:02}", f"text {i}") for i in range(400)]
    df = spark.createDataFrame(rows, "review_id long, user_id string, text string")
    pieces = reshape.text_pieces(df, "user_id", "text", ["review_id"])
    found = pieces.collect()
    assert sum(not r["alone"] for r in found) <= 2 * 4 + 4  # the first and last key of each of 4 tasks
    whole = {r["user_id"]: (r["n_texts"], r["text"]) for r in reshape.whole_texts(pieces, "user_id").collect()}
    assert whole == {f"u{u:02}": (10, " ".join(f"text {i}" for i in range(u, 400, 40))) for u in range(40)}


def test_documents_find_their_cells_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(paragraph, "TOKENS_PER_CELL", 6)
    rows = [(str(i), "item", "big" if i % 2 else f"t{i}", ["a", "b"]) for i in range(20)] + [("x", "item", None, ["a"])]
    docs = spark.createDataFrame(rows, "doc string, what string, tag string, tokens array<string>")
    placed = paragraph._cells(docs, 64)
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    found = placed.collect()
    assert len(found) == 20  # a document without a tag takes no part
    assert len({r["cell"] for r in found if r["tag"] == "big"}) > 1


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lemmas_shuffle_no_row_per_word(spark):
    lemmas = spark.createDataFrame([("cats", "cat"), ("ran", "run"), ("ran", "running"), ("x", None)], "form string, lemma string")
    rows = [(1, ["the", "cats", "ran"]), (2, ["x", "cats"]), (3, ["cats"]), (3, ["a", "ran"]), (4, []), (5, None), (5, ["ran"]), (None, ["cats"])]
    out = text.lemmatise(spark.createDataFrame(rows, "k long, t array<string>"), "t", "k", lemmas)
    assert "posexplode" not in plan_of(out)
    found = sorted(((r["k"], r["t"]) for r in out.collect()), key=lambda r: (r[0] is None, r))
    merged = ["a", "cat", "run"]  # rows that share a key
    assert found == [(1, ["the", "cat", "run"]), (2, ["x", "cat"]), (3, merged), (3, merged), (4, []), (5, ["run"]), (5, ["run"]), (None, ["cats"])]


def test_texts_are_joined_last(spark):
    texts = spark.createDataFrame([(1, "one"), (2, ""), (3, "three")], "doc_id long, review_text string")
    meta = spark.createDataFrame([("a", "A"), ("b", "getTime(")], "item_id string, title string")
    reviews = spark.createDataFrame([("u", "a", 1), ("v", "a", 2), ("w", "b", 3), ("x", "a", 9)], "user_id string, item_id string, doc_id long")
    ledger = accounting.Ledger()
    kept = accounting.prepare(reviews, meta, ["title", "review_text"], ledger, texts=texts)
    plan = plan_of(kept)
    assert plan.index("SortMergeJoin [doc_id") < plan.index("Join [item_id")
    assert [(r["user_id"], r["review_text"]) for r in kept.collect()] == [("u", "one")]
    assert ledger.counts()["joined"] == {"rows": 2, "no_title": 0, "no_review_text": 1}


def test_terms_are_not_shuffled(spark, monkeypatch):
    rows = [(1, "a b a"), (1, "b c"), (2, "a"), (None, "a d"), (None, "d"), (3, None)]
    docs = spark.createDataFrame(rows, "k long, processed_text string")
    wanted = {(1, "a", 2), (1, "b", 2), (1, "c", 1), (2, "a", 1), (None, "a", 1), (None, "d", 2)}
    assert set(map(tuple, topics.term_counts(docs, "k").collect())) == wanted
    plan = plan_of(topics.term_counts(docs.where("k is not null"), "k"))
    assert "ENSURE_REQUIREMENTS" not in plan and "REPARTITION_BY_COL" in plan
    monkeypatch.setattr(topics, "HEAVY_ROWS", 1)
    assert set(map(tuple, topics.term_counts(docs, "k").collect())) == wanted


def test_weights_stay_with_their_document(spark):
    docs = spark.createDataFrame([(i, f"all w{i % 3} v{i % 5}") for i in range(30)], "k long, processed_text string")
    weights = topics.tfidf(topics.term_counts(docs, "k"), "k", F.lit(30))
    assert "ENSURE_REQUIREMENTS" not in plan_of(weights).replace("BroadcastExchange", "")
    found = weights.collect()
    assert len(found) == 60 and abs(sum(r["weight"] ** 2 for r in found) - 30) < 1e-9


def test_terms_meet_inside_their_document(spark):
    counts = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (2, "a", 2), (3, "b", 1), (None, "a", 1), (None, "b", 1)], "k long, term string, tf long")
    top = spark.createDataFrame([(0, 0, "a"), (0, 1, "b")], "topic int, place int, term string")
    scores = topics.coherence(top, counts, "k", F.lit(4))
    assert plan_of(scores).count("hashpartitioning(k#") <= 1  # terms were joined with each other by key before
    assert abs(scores.first()["coherence"] - np.log((1 / 4 + 1e-12) / (3 / 4))) < 1e-9


def test_sent_tokens_are_held_once():
    """Tokens came with a copy of their node and size each before they were packed."""
    lines = [" ".join(f"w{i}x{j}" for j in range(2_000)) for i in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), pa.array(lines)], names=["node", "text"])
    tracemalloc.start()
    rows = list(signature_trees._sent(3, 4)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    tokens = sum(len(x) // 8 for r in rows for x in r.column("tokens").to_pylist())
    assert tokens == 200 * 1_998
    assert peak < 125 * tokens  # 152 bytes a token before
