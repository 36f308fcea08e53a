"""Spelling variants, the n-gram join and whitening against brute force on small fixtures."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from reviewloom.llm import queries, signature_trees, variants, whitening

SCHEMA = "doc_id long, text string, n long, node string, comp long, token long, word string, row long"
EDGES = [
    (None, "one two three four five"), (7, None), (8, ""), (9, " \n\t "), (10, "word"), (10, "word"), (11, "x " * 30_000),
    (12, "one two three four five"), (13, "One  TWO three four five"), (14, "a b"), (15, "A b"),
]


def docs_of(spark, rows):
    """Rows (doc_id, text) with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 1, "x", 2, 3, "y", 4) for r in rows], SCHEMA)


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def key(rows):
    return sorted(map(repr, (tuple(r) for r in rows)))


def brute_components(rows, percent, width):
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]) and None not in (rows[i][0], rows[j][0]):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[root(i)].append(r[0])
    return [(r[0], len(sets[i]), None if r[0] is None else min(least[root(i)])) for i, r in enumerate(rows)]


def families(rng, n):
    """Texts that differ from a few others in about as many words as the threshold allows, and one passage in many."""
    common = " ".join(f"c{i}" for i in range(30))
    rows = []
    for f in range(n):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([5, 25, 60, 120, 200]))]
        for _ in range(rng.randrange(1, 9)):
            text = list(base)
            for _ in range(rng.randrange(0, 3)):
                text[rng.randrange(len(text))] = f"v{rng.randrange(1000)}"
            if rng.random() < 0.3:
                text = text[: rng.randrange(max(1, len(text) - 5), len(text) + 1)]
            rows.append((100 + len(rows), " ".join(text) + (" " + common if f % 2 else "")))
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_ngram_join(spark, monkeypatch, small):
    if small:  # large trees, cut into blocks
        monkeypatch.setattr(signature_trees, "TREE_TEXTS", 5)
        monkeypatch.setattr(signature_trees, "TREE_TOKENS", 300)
        monkeypatch.setattr(signature_trees, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(signature_trees, "BUCKET_TOKENS", 500)
        monkeypatch.setattr(signature_trees, "FIRST", 1)
    rows = EDGES + families(random.Random(3), 60)
    got = signature_trees.linked(docs_of(spark, rows), 90, 3, carry=("n", "token")).collect()
    assert {(r["n"], r["token"]) for r in got} == {(1, 3)}
    assert key(r[:3] for r in got) == key(brute_components(rows, 90, 3))
    assert len({r.component_id for r in got}) < len(got) - 50


def test_ngram_join_other_widths_and_empty(spark):
    rows = EDGES + families(random.Random(4), 25)
    got = signature_trees.linked(docs_of(spark, rows)).collect()
    assert key(got) == key(brute_components(rows, 80, 5))
    assert signature_trees.linked(docs_of(spark, rows[:0])).count() == 0


@pytest.mark.parametrize("sided", [False, True])
def test_links_in_join_all_that_is_linked(sided):
    rng = np.random.default_rng(5)
    base = [np.sort(rng.choice(1 << 40, 60, replace=False).astype(np.uint64)) for _ in range(30)]
    sets = []
    for _ in range(400):
        one = base[rng.integers(30)]
        gone = rng.choice(60, rng.integers(0, 6), replace=False)
        sets.append(np.unique(np.concatenate([np.delete(one, gone), rng.integers(0, 1 << 40, rng.integers(0, 4)).astype(np.uint64)])))
    comps, sides = np.arange(400), rng.integers(0, 2, 400) if sided else np.zeros(400, dtype=np.int64)
    found = signature_trees.links_in(sets, comps, sides, 90)
    parent = list(range(400))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in found:
        assert root(i) != root(j) and (not sided or sides[i] != sides[j])
        parent[root(i)] = root(j)
    for i in range(400):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both) and (not sided or sides[i] != sides[j]):
                assert root(i) == root(j)


def test_shared_counts(monkeypatch):
    monkeypatch.setattr(signature_trees, "MET_COLUMNS", 3)
    rng = np.random.default_rng(6)
    lists = [rng.choice(60, rng.integers(0, 9), replace=False) for _ in range(25)] + [np.empty(0, dtype=np.int64)]
    got = signature_trees.shared_counts(lists)
    for i, a in enumerate(lists):
        assert all(got[i, j] == len(set(a.tolist()) & set(b.tolist())) for j, b in enumerate(lists) if i != j)


def test_linked_sets_are_never_ruled_out():
    rng = np.random.default_rng(7)
    common = rng.integers(0, 1 << 40, 30).astype(np.uint64)
    sets = []
    for _ in range(40):
        base = np.concatenate([rng.integers(0, 1 << 40, rng.integers(5, 80)).astype(np.uint64), rng.choice(common, 10, replace=False)])
        for _ in range(5):
            gone = rng.choice(len(base), rng.integers(0, 5), replace=False)
            sets.append(np.unique(np.concatenate([np.delete(base, gone), rng.integers(0, 1 << 40, rng.integers(0, 4)).astype(np.uint64)])))
    texts = Counter(t for s in sets for t in s.tolist())
    n = np.array([len(s) for s in sets])
    counts = signature_trees.first_tokens(n, 90)
    ordered = [sorted(s.tolist(), key=lambda t: (texts[t], t))[:k] for s, k in zip(sets, counts, strict=True)]
    alone = np.array([sum(texts[t] == 1 for t in o) for o in ordered])
    usable = [i for i, o in enumerate(ordered) if alone[i] < len(o)]
    first = [np.array(ordered[i][alone[i] :], dtype=np.int64) for i in usable]
    last = np.array([texts[ordered[i][-1]] for i in usable])
    fits = signature_trees.may_link(first, last, alone[usable], n[usable], 90)
    at = {i: k for k, i in enumerate(usable)}
    linked = ruled_out = 0
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 90 * (n[i] + n[j] - both) and texts and not np.array_equal(sets[i], sets[j]):
                linked += 1
                assert fits[at[i], at[j]] and fits[at[j], at[i]]
            else:
                ruled_out += i not in at or j not in at or not fits[at[i], at[j]]
    assert linked > 30 and ruled_out > 15_000


def brute_vocabulary(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 3}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    n = brute_vocabulary(rows)
    form, count = {}, {}
    for w in n:
        close = [v for v in n if near(w, v)]
        count[w] = len(close)
        best = min(close, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], count[w], n[form[w]] if form[w] else None))
    return out


def test_spelling_variants(spark):
    rng = random.Random(8)
    letters = "abcde\xe9\xff\xd7"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(4, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "abcab" * 600]
    for w in list(words):
        i = rng.randrange(len(w))
        words += [w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]]
    rows = [(d, " ".join(rng.choice(words[: rng.choice([20, 80, len(words)])]) for _ in range(60))) for d in range(200)]
    rows += [(None, "aaaaa AAAAA aaaaa1aaaaab"), (7, None), (8, ""), (9, "12 34"), (9, "12 34"), (300, "abcdefgh" * 4_000), rows[0]]
    got = variants.spelling_variants(docs_of(spark, rows)).collect()
    want = brute_variants(rows)
    assert len(want) > 100 and sum(r[1] is not None for r in want) > 20
    assert any(r[1] is not None and r[1] != r[2] for r in want)
    assert key(got) == key(want)
    assert variants.spelling_variants(docs_of(spark, rows[:0])).count() == 0


def test_shards_that_are_cut(spark):
    rng = random.Random(9)
    words = sorted({"aa" + "".join(rng.choice("abz") for _ in range(rng.randrange(3, 6))) for _ in range(300)})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    want = sorted((a, b) for a in words for b in words if near(a, b))
    assert sorted(map(tuple, variants.near_words(df, shard_words=7).collect())) == want


def test_suffix_array():
    rng = np.random.default_rng(2)
    for text in (rng.integers(0, 3, 200), np.zeros(50, dtype=int), np.array([4])):
        want = sorted(range(len(text)), key=lambda i: list(text[i:]))
        assert variants.suffix_array(text).tolist() == want


def brute_whitening(rows):
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept])
    d = len(kept) * x - x.sum(axis=0)
    inner = d / len(kept)
    return [i for i, _ in kept], d, inner, inner.T @ inner / len(kept)


@pytest.mark.parametrize("dims", [3, 40])
def test_whitening(spark, dims):
    rng = np.random.default_rng(dims)
    spread = np.linspace(0.2, 9, dims)
    rows = [(i, (rng.normal(size=dims) * spread).tolist()) for i in range(400)]
    rows += [rows[0], rows[1], (None, rows[2][1]), (500, None), (501, [None] * dims), (502, [math.nan] * dims), (503, [math.inf] + [0.0] * (dims - 1)), (504, [])]
    rows += [(1000 + i, [0.25] * dims) for i in range(200)]  # one vector that a third of all rows hold
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<double>, n long, x double").repartition(37)
    got = whitening.whitened(whitening.quantised(df)).collect()
    ids, d, inner, cov = brute_whitening(rows)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    count = min(dims, 32)
    assert len(got) == len(ids) * count and {r.n for r in got} == {len(ids)}
    assert max(abs(r.explained / (values[r.component - 1] / np.trace(cov)) - 1) for r in got) < 1e-10
    assert {r.identity_error for r in got} and got[0].identity_error < 1e-9
    want = defaultdict(list)
    for i, row, wide in zip(ids, inner, d, strict=True):
        want[i].append((int((wide.astype(object) ** 2).sum()), row))
    signs = {}
    table = defaultdict(dict)
    for r in got:
        table[r.vec_id].setdefault(r.component, []).append((r.deviation, r.whitened))
    for j in range(1, count + 1):
        expected = {i: (row @ axes[:, j - 1]) / math.sqrt(values[j - 1]) for i, ((_, row), *_) in want.items()}
        big = max(expected, key=lambda i: abs(expected[i]))
        signs[j] = math.copysign(1, table[big][j][0][1] * expected[big])
        for i, e in expected.items():
            for deviation, w in table[i][j]:
                assert deviation in {x for x, _ in want[i]}
                assert abs(signs[j] * w - e) < 1e-7
    assert len(table[0][1]) == 2


def test_whitening_without_variance(spark):
    rows = [(1, [1.0, 2.0, 3.0]), (2, [1.0, 4.0, 3.0]), (2, [1.0, 4.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whitened(whitening.quantised(df)).collect()
    assert sorted((r.vec_id, r.component, r.whitened is None) for r in got) == sorted(
        (i, c, c > 1) for i in (1, 2, 2) for c in (1, 2, 3)
    )
    assert {round(r.explained, 12) for r in got} == {1.0, 0.0} and got[0].identity_error < 1e-12
    one = whitening.whitened(whitening.quantised(df.where("vec_id = 1"))).collect()
    assert [(r.whitened, r.explained, r.deviation) for r in one] == [(None, 0.0, 0)] * 3
    assert whitening.whitened(whitening.quantised(df.where("false"))).count() == 0


def test_spectra_stay_orthogonal():
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(2_000, 12)) * 50).astype(np.int64) + 1_000_000
    x[:, :3] = 1_000_007
    parts = [whitening.Spectrum(12) for _ in range(5)]
    for k, part in enumerate(parts):
        part.add(x[k::5])
    total = parts[0]
    for part in parts[1:]:
        total = total.merge(part)
    inner = x - x.mean(axis=0)
    assert np.abs(total.vectors.T @ total.vectors - np.eye(12)).max() < 1e-12
    assert np.abs(total.vectors * total.values @ total.vectors.T - inner.T @ inner).max() < 1e-8 * np.abs(inner.T @ inner).max()
    assert total.n == 2_000 and total.sums.tolist() == x.sum(axis=0).tolist()


def test_queries_on_the_smallest_tables(spark, root):
    rows = [tuple(r) for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").collect()]
    assert key(queries.QUERIES["op11_variants"](spark, root).collect()) == key(brute_variants(rows))
    vectors = [tuple(r) for r in spark.read.parquet(f"{root}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = queries.QUERIES["op13_whitening"](spark, root).collect()
    ids, _, inner, cov = brute_whitening(vectors)
    assert len(got) == len(ids) * 32 and got[0].identity_error < 1e-9
