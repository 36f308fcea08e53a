"""Each operator against brute force on small fixtures: nulls, empty texts, ties, repeated rows, empty tables, extra columns."""

import base64
import gzip
import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reviewloom.llm import (
    chain,
    exact_dups,
    graph,
    hmm,
    language,
    line_dedup,
    mixing,
    near_dups,
    pieces,
    secrets,
    topk,
    warc,
)
from reviewloom.llm.queries import MODEL

SCHEMA = "doc_id long, text string, lang string, source string, kept boolean, cluster long, a string, size string, row long"


def docs_of(spark, rows):
    """Rows (doc_id, text[, lang[, source]]) with further columns whose names the operators use themselves."""
    full = [(*r, *[None] * (4 - len(r)), True, 1, "x", "y", 7) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


EDGES = [
    (None, "one two three four five"), (7, None), (8, ""), (9, " \n\t "), (10, "word"), (10, "word"), (11, "x " * 30_000),
    (12, "one two three four five"), (13, "One  TWO three four five"),
]


def test_top_k(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.5, 0.1]) for _ in range(4)]) for i in range(300)]
    rows += [(300, None), (301, [None, 1.0]), (302, [float("nan")] * 4), (303, [math.inf, 0.0, 0.0, 0.0]), (None, [0.5] * 4)]
    rows += [(50, rows[50][1]), (304, [0.5, 0.5]), (350, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score long")
    q = topk.quantised(df, "vec_id", "embedding")
    got = topk.top_k(q.where("vec_id % 50 = 0"), q, 5, tiles=(2, 5)).collect()
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None
             and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for i, v in {(i, tuple(v)) for i, v in whole if i % 50 == 0}:
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in whole if j != i and len(w) == len(v))
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(found[:5])]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert topk.top_k(q.where("false"), q.where("false")).count() == 0


def test_products_beyond_doubles():
    big = np.array([[2.0**40, 1.0]])
    assert topk.products(big, np.array([[2.0**20, 1.0], [2.0**40, 0.0]])).tolist() == [[2**60 + 1, (1 << 63) - 1]]


def brute_components(rows, percent=80):
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append(set(zip(w, w[1:], strict=False)) if len(w) > 1 else {tuple(w)} if w else set())
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
    out = []
    for i, r in enumerate(rows):
        comp = None if r[0] is None else min(least[root(i)])
        out.append((r[0], len(sets[i]), comp, r[0] is None or r[0] == comp))
    return out


def key(rows):
    return sorted(map(repr, (tuple(r) for r in rows)))


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "DIRECT_MEMBERS", 6)  # so that tiles are used
    monkeypatch.setattr(near_dups, "TILE_SHINGLES", 400)
    monkeypatch.setattr(near_dups, "MEMBERS_PER_TASK_GROUP", 5)
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows = list(EDGES)
    at = 100
    for size, rate in ((60, 0.06), (40, 0.13), (5, 0.02)):
        base = [rng.choice(vocab) for _ in range(60)]
        for _ in range(size):
            rows.append((at, " ".join(w if rng.random() > rate else rng.choice(vocab) for w in base)))
            at += 1
    rows += [(at + i, " ".join(rng.choice(vocab) for _ in range(40))) for i in range(60)]
    got = near_dups.near_duplicates(docs_of(spark, rows), width=2).collect()
    assert key(got) == key(brute_components(rows))
    assert near_dups.near_duplicates(docs_of(spark, rows[:1]).where("false")).count() == 0


@pytest.mark.parametrize("direct", [6, 1_000])
def test_near_duplicates_of_texts_that_share_a_doc_id(spark, monkeypatch, direct):
    monkeypatch.setattr(near_dups, "DIRECT_MEMBERS", direct)
    rng = random.Random(15)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(4):
        base = [rng.choice(vocab) for _ in range(60)]
        rows += [(i, " ".join(w if rng.random() > 0.08 else rng.choice(vocab) for w in base)) for i in range(20)]
    got = near_dups.near_duplicates(docs_of(spark, rows), width=2).collect()
    assert key(got) == key(brute_components(rows))


def test_tiles_are_bounded_in_texts(spark, monkeypatch):
    """Short texts by one template: few shingles, many texts."""
    n = 5_000
    lines = [f"Order {i} has been shipped" for i in range(n)]
    keys = [i.to_bytes(4, "big") for i in range(n)]
    side = [i % 2 == 0 for i in range(n)]
    lines[1] = lines[4_998]  # a link between the sides
    tile = pa.table({"node": pa.array(keys, pa.binary()), "comp": pa.array(keys, pa.binary()), "is_rest": side, "text": lines})
    monkeypatch.setattr(near_dups, "SCORES", 500_000, raising=False)
    tracemalloc.start()
    got = near_dups._tile(80)(tile)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert got.to_pylist() == [{"a": keys[4_998], "b": keys[1]}]
    assert peak < 4 * 2 * (n // 2) * near_dups.TILE_COLUMNS + 20e6  # the two incidence matrices, and little else

    def counted(percent):
        return lambda tile: pa.table({c: pa.array([str(pa.compute.sum(x).as_py()).encode()], pa.binary()) for c, x in (
            ("a", tile["is_rest"]), ("b", pa.compute.invert(tile["is_rest"])))})

    monkeypatch.setattr(near_dups, "_tile", counted)
    whole = spark.createDataFrame([(bytearray(k), i, t) for i, (k, t) in enumerate(zip(keys, lines, strict=True))], "node binary, rep long, text string")
    large = whole.select("node", F.col("node").alias("comp"), F.lit(keys[0]).alias("one"))
    classes = whole.select("node", "rep", F.lit(4).alias("n"))
    sides = near_dups._in_tiles(large, classes, whole.select(F.col("rep").alias("doc_id"), F.col("rep").alias("row"), "text"), 80).collect()
    assert max(int(x) for r in sides for x in r) < 2_200


def test_likelihood_keeps_similar_sets():
    rng = np.random.default_rng(1)
    for similarity, kept in ((0.8, True), (0.3, False)):
        n = 2_000
        both = round(2 * n * similarity / (1 + similarity))
        pool = rng.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)
        a, b = pool[:n], pool[n - both :]
        regs = near_dups.registers_of(np.concatenate([a, b]), np.array([0, n, 2 * n]))
        union = near_dups.registers_of(pool, np.array([0, len(pool)]))
        assert (np.maximum(regs[0], regs[1]) == union[0]).all()  # sketches merge
        assert near_dups.may_reach(regs[:1], regs[1:], np.array([n]), np.array([n]), 80)[0] == kept


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(30, 31), (31, 32), (40, 40), (50, 99), (50, 98)]
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(21)}, 30: 30, 31: 30, 32: 30, 50: 50, 98: 50, 99: 50}


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(graph, "HEAVY", 5)
    edges = [(7, 100 + i) for i in range(60)] + [(100 + i, 300 + i) for i in range(20)] + [(3, 305), (900, 901)] + [(800, 810 + i) for i in range(9)]
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {v: 3 for v in [3, 7, *range(100, 160), *range(300, 320)]} | {900: 900, 901: 900} | {v: 800 for v in [800, *range(810, 819)]}
    assert got == want


def test_chain_equals_plain_recursion():
    rng = np.random.default_rng(2)
    trans = rng.uniform(0.1, 1, (3, 3))
    bounds = np.array([0, 0, 1, 70, 70, 103])
    scores = rng.uniform(0.01, 1, (103, 3))
    initial = np.array([0.5, 0.3, 0.2])
    sums, likely = chain.log_sums(scores, bounds, trans, initial), chain.marginals(scores, bounds, trans, initial)
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        ahead, back, now = [], [], initial
        for t in range(a, b):
            now = (now @ trans) * scores[t]
            ahead.append(now)
        assert math.isclose(sums[k], math.log(now.sum()) if b > a else 0.0, abs_tol=1e-9)
        now = np.ones(3)
        for t in reversed(range(a, b)):
            back.insert(0, now)
            now = trans @ (scores[t] * now)
        if b > a:
            each = np.array(ahead) * np.array(back)
            assert np.allclose(likely[a:b], each / each.sum(axis=1, keepdims=True))


def test_language(spark):
    rng = random.Random(4)
    syllables = {"xx": ["ba", "bo", "bu", "ma"], "yy": ["ti", "te", "ki", "se"]}

    def text(lang, n):
        return " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))

    rows = [(i, text(lang, rng.randint(3, 60)), lang) for i, lang in enumerate(["xx", "yy"] * 150)]
    mixed = (900, text("xx", 30) + " " + text("yy", 10), None)
    rows += [mixed, (901, None, "xx"), (902, "", "yy"), (903, "12 34 !!", "yy"), (None, text("yy", 20), "yy"), (5, text("yy", 50), "yy")]
    got = language.identified(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    truth = {i: lang for i, _, lang in rows[:300] if i != 5}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    by = {r.doc_id: r for r in got}
    assert by[900].lang_pred == "xx" and by[900].n_switches >= 1
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (901, 902, 903))
    assert all(0 <= r.score <= 1 for r in got) and by[None].lang_pred == "yy"
    unlabelled = language.identified(docs_of(spark, [(1, "abc")])).collect()
    assert [r.lang_pred for r in unlabelled] == ["und"]


def test_secrets(spark):
    key_ = "AKIA" + "ABCDEFGH12345678"
    rng = random.Random(6)
    rows = [(i, f"é token = \"{rng.randbytes(20).hex()}\" and some_ordinary_identifier is listed") for i in range(40)]
    odd = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(120))
    rows += [(60 + i, "quickly jumping zebras vexing wizards_of_oz Configuration_Manager hypothetical") for i in range(20)]
    rows += [
        (50, f"ü {key_} Api-key Api_Key: '{'x' * 6}' token=token: abcdefgh"), (51, None), (52, ""), (53, f"plain {odd} words"),
        (54, "ſecret = abcdefgh PASSWD='short' passWord:=longer_one"), (54, "deadbeef" * 3), (55, "a" * 24 + "\n" + "AKIAshort"),
    ]
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    want = []
    for i, text in rows:
        found = [(m.start(), 0, m.end()) for m in assign.finditer(text or "") if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text or "") if len(m[0]) >= 24]
        want.append((i, tuple(sorted(found))))
    got = secrets.secret_spans(docs_of(spark, rows)).collect()
    base = [(r.doc_id, tuple((s.start, secrets.KINDS.index(s.kind), s.end) for s in r.spans if s.kind != "markov")) for r in got]
    assert sorted(base) == sorted(want)
    markov = [(r.doc_id, s.start, s.end) for r in got for s in r.spans if s.kind == "markov"]
    assert markov == [(53, 6, 126)]


def test_exact_duplicates(spark):
    rows = [*EDGES, (20, "onetwothreefourfive"), (21, "one two three four five "), (22, "one two three four five "), (None, "alone")]
    rows += [(100 + i, "same text") for i in range(200)] + [(400 + i, f"text {i % 37}") for i in range(100)]
    got = exact_dups.exact_duplicates(docs_of(spark, rows), frequent=5, counters=8).collect()
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((i, len(text or "")))
    want = []
    for plain, members in groups.items():
        keep, size = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))
        digest = hashlib.sha256(plain.encode()).hexdigest()
        want += [(i, keep, len(members), i == keep and n == size, digest) for i, n in members]
    assert key(got) == key(want)
    assert exact_dups.exact_duplicates(docs_of(spark, rows).where("false")).count() == 0


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(**pieces.read_model(MODEL))


def test_pieces_equal_the_library(codec):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(8)
    parts = ["a", "th", "ing", " ", "  ", "\n", "é", "中", "😀", "▁", "<s>", "<0x41>", "tion", "!!!", "----", "The", "(", "\x00", "xyzzy"]
    texts = ["", None, " ", "   a", "ab" * 3_000, "=" * 500] + ["".join(rng.choices(parts, k=rng.randint(1, 60))) for _ in range(800)]
    ids, bounds = codec.encode(pa.array(texts))
    for t, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
        assert ids[a:b].tolist() == library.encode(t or "")
        assert codec.decode(ids[a:b].tolist()) == (t or "").replace("▁", " ")


def test_streaming_search_equals_merging(codec):
    rng = random.Random(9)
    for _ in range(60):
        text = "".join(rng.choices("abcdeinorst", k=rng.randint(1, 300)))
        assert list(codec.segments(text)) == codec.merged(text)


def test_unigram_search():
    names = ["<unk>", "a", "b", "ab", "aba", "▁"]
    kinds = [pieces.UNKNOWN] + [pieces.NORMAL] * 5
    scores = [0.0, -2.0, -2.0, -3.0, -9.0, -1.0]
    model = pieces.Codec(names, scores, kinds, bpe=False, prefix=False)
    ids, _ = model.encode(pa.array(["ababa b??a"]))
    assert ids.tolist() == [3, 3, 1, 5, 2, 0, 1]


def test_pieces_on_tables(spark):
    rows = [*EDGES, (30, "naïve ▁ 中文 end")]
    coded = pieces.encoded(docs_of(spark, rows), MODEL, check=True)
    assert coded.where("not restored").count() == 0 and coded.count() == len(rows)
    back = pieces.decoded(coded.where("doc_id = 30"), MODEL).first()
    assert back.text == "naïve   中文 end"


@pytest.mark.parametrize("size", ["128m", "997"])
def test_archives(spark, tmp_path, size):
    rng = random.Random(10)
    big = rng.randbytes(9_000).hex()
    rows = [(i, f"http://x/{i}\r\nInjected: y", rng.randbytes(300).hex() if i % 3 else big) for i in range(60)]
    rows += [(None, None, "é" * 60), (70, "u", None), (71, "u", ""), (72, "u", "a" * 99), (73, "u", "a" * 99), (74, None, "b" * 100), (75, "u", "b" * 100), (75, "u", "b" * 100)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload string")
    path = str(tmp_path / "archives")
    warc.write_archives(df, path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = warc.read_archives(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    least = {}
    for i, _, html in rows:
        if len((html or "").encode()) >= 100 and i is not None:
            least[html] = min(least.get(html, i), i)
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        refers = least.get(html) if least.get(html, i) != i else None
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if refers is None else "revisit", refers, html if refers is None else None))
    found = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload) for r in got]
    want = [(*w[:5], w[5].encode() if w[5] is not None else b"" if w[3] == "response" else None) for w in want]
    assert key([(*f[:5], bytes(f[5]) if f[5] is not None else None) for f in found]) == key(want)


def test_archive_pieces_are_put_together():
    """A record with the magic inside its compressed bytes, cut there."""
    record = warc._record(1, "u", "x" * 200, 200, hashlib.sha256(b"x" * 200).hexdigest(), None, "d")
    packer = zlib.compressobj(0, zlib.DEFLATED, 31)  # stored, so that the magic survives
    html = "x" * 50 + "MAGIC" + "y" * 50
    record = warc._record(1, "u", html, 105, hashlib.sha256(html.replace("MAGIC", "\x1f\x01").encode()).hexdigest(), None, "d")
    raw = record.replace(b"MAGIC", b"\x1f\x8b\x08")
    digest = hashlib.sha256(raw.split(b"\r\n\r\n")[2][:103]).hexdigest().encode()
    raw = re.sub(rb"sha256:\w+", b"sha256:" + digest, raw).replace(b"Content-Length: 105", b"Content-Length: 103")
    raw = re.sub(rb"(?<=\r\nContent-Length: )(\d+)(?=\r\n\r\nHTTP)", lambda m: str(int(m[1]) - 2).encode(), raw)
    member = packer.compress(raw) + packer.flush()
    values = member.split(warc.MAGIC)
    assert len(values) == 3
    batch = pa.RecordBatch.from_pydict({"value": pa.array(values, pa.binary()), "file": ["f"] * 3, "begins": [0, 0, 0]})
    whole = pa.Table.from_batches(list(warc._owned(True)([batch]))).to_pylist()
    assert [r["page_id"] for r in whole] == [1]
    batch = pa.RecordBatch.from_pydict({"value": pa.array(values, pa.binary()), "file": ["f"] * 3, "begins": [0, 0, 40]})
    cut = pa.Table.from_batches(list(warc._owned(True)([batch])))
    assert [r["part"] for r in cut.to_pylist()] == [0, 1]
    assert [r["page_id"] for r in warc._stitched(True)(cut).to_pylist()] == [1]


def standard_record(kind, record_id, block, *headers):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Date: 2024-05-01T00:00:00Z", f"WARC-Record-ID: <urn:uuid:{record_id}>", *headers]
    return gzip.compress(("\r\n".join(lines) + f"\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n")


@pytest.mark.parametrize("size", ["128m", "997"])
def test_standard_archives(spark, tmp_path, size):
    """Files as crawlers write them, whatever their names: all record types, SHA-1 digests, mixed-case and folded headers."""
    rng = random.Random(12)
    want = []
    for file in ("a.warc.gz", "b.warc", "c.open.gz"):
        raw = standard_record("warcinfo", f"{file}-i", b"software: test\r\n", "Content-Type: application/warc-fields")
        want.append((f"urn:uuid:{file}-i", None, "warcinfo", b"software: test\r\n", None))
        for i in range(12):
            body = rng.randbytes(700) + "é".encode()
            http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + body
            sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
            raw += standard_record("request", f"{file}-q{i}", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n", "Content-Type: application/http; msgtype=request")
            want.append((f"urn:uuid:{file}-q{i}", None, "request", b"", None))
            raw += standard_record("response", f"{file}-{i}", http, f"warc-target-uri: http://x/{i}", "Content-Type:\r\n application/http", f"WARC-Payload-Digest: sha1:{sha}")
            want.append((f"urn:uuid:{file}-{i}", f"http://x/{i}", "response", body, None))
        raw += standard_record("revisit", f"{file}-r", b"", "WARC-Payload-Digest: sha1:ABC", f"WARC-Refers-To: <urn:uuid:{file}-0>")
        want.append((f"urn:uuid:{file}-r", None, "revisit", None, f"urn:uuid:{file}-0"))
        (tmp_path / file).write_bytes(raw)
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = warc.read_archives(spark, str(tmp_path)).collect()
        slim = warc.read_archives(spark, str(tmp_path), payload=False).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert key((r.record_id, r.url, r.record_type, bytes(r.payload) if r.payload is not None else None, r.refers_to_id) for r in got) == key(want)
    assert {r.page_id for r in got} == {None}
    for r in got:
        if r.record_type == "revisit":
            assert r.payload_digest == "sha1:ABC" and r.payload_bytes is None
        else:
            assert (r.payload_bytes, r.payload_digest) == (len(r.payload), hashlib.sha256(bytes(r.payload)).hexdigest())
    assert key((r.record_id, r.payload_bytes, r.payload_digest, r.payload) for r in slim) == key((r.record_id, r.payload_bytes, r.payload_digest, None) for r in got)


@pytest.mark.parametrize("raw", [b"no archive at all", gzip.compress(b"text"), standard_record("resource", "x", b"y" * 500)[:-40]])
def test_archives_without_whole_records_are_errors(spark, tmp_path, raw):
    (tmp_path / "good.warc.gz").write_bytes(standard_record("resource", "x", b"y" * 500))
    (tmp_path / "bad.warc.gz").write_bytes(raw)
    with pytest.raises(Exception, match="no record|cut off"):
        warc.read_archives(spark, str(tmp_path)).collect()


def test_damaged_payloads_are_errors():
    record = gzip.decompress(standard_record("resource", "x", b"yy", "WARC-Payload-Digest: sha1:" + "A" * 32))
    with pytest.raises(ValueError, match="damaged"):
        warc.parsed(record)


def test_archives_of_an_empty_table(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "a"))
    assert warc.read_archives(spark, str(tmp_path / "a")).count() == 0


def test_runs_of_long_words_are_cut(spark):
    """A sample of texts without blanks stays bounded in characters."""
    docs = spark.range(40).selectExpr("id as doc_id", "repeat(char(97 + id % 20), 200000) as text", "'x' as lang")
    runs = language.samples_of(docs)
    assert runs and max(len(r) for r, _ in runs) == language.SAMPLE_CHARS


def brute_lines(rows, min_words):
    lines = {}
    for n, (i, text) in enumerate(rows):
        full = [(at, x.strip(" \t\n\x0b\x0c\r")) for at, x in enumerate((text or "").split("\n"))]
        lines[((i is None), i or 0, n)] = [(at, x) for at, x in full if x]
    gone = set()
    order = sorted(lines)
    for d in order:
        own = lines[d]
        for p in range(len(own)):
            best = 0
            for e in order:
                if e > d:
                    break
                other = lines[e]
                for q in range(len(other) if e < d else p):
                    n = 0
                    while p + n < len(own) and q + n < len(other) and own[p + n][1] == other[q + n][1]:
                        n += 1
                    best = max(best, n)
            if sum(len(x.split()) for _, x in own[p : p + best]) >= min_words and best:
                gone |= {(d, own[p + k][0]) for k in range(best)}
    out = []
    for d in order:
        text = rows[d[2]][1]
        kept = None if text is None else "\n".join(x for at, x in enumerate(text.split("\n")) if (d, at) not in gone)
        out.append((rows[d[2]][0], kept, 0 if text is None else len(text.split("\n")), sum(g[0] == d for g in gone)))
    return out


@pytest.mark.parametrize("min_words", [1, 4, 9])
def test_line_dedup(spark, min_words):
    rng = random.Random(min_words)
    pool = ["a b", "c", "d e f", "g h i j k", " a b ", "", "\r"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(40)]
    rows += [(50, None), (51, ""), (None, "g h i j k\nc\nd e f"), (52, "\n".join(["only here once"] * 5)), (53, "x " * 5_000)]
    got = line_dedup.drop_repeated_lines(docs_of(spark, rows), min_words).collect()
    assert key(got) == key(brute_lines(rows, min_words))
    assert line_dedup.drop_repeated_lines(docs_of(spark, rows).where("false")).count() == 0


def brute_runs(rows, min_words):
    """Longest run at each line that also starts at an earlier one, without those that end inside another."""
    spots = []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        full = [(at, x.strip(" \t\n\x0b\x0c\r")) for at, x in enumerate((text or "").split("\n"))]
        own = [(at, x) for at, x in full if x]
        spots += [(i, at, [x for _, x in own[p:]]) for p, (at, _) in enumerate(own)]
    out, end, last = [], 0, object()
    for p, (i, at, mine) in enumerate(spots):
        if i != last:
            end, last = 0, i
        best = (0, None)
        for q in range(p):
            n = next((k for k, (x, y) in enumerate(zip(mine, spots[q][2], strict=False)) if x != y), min(len(mine), len(spots[q][2])))
            if n > best[0]:
                best = (n, spots[q][:2])
        if best[0] and sum(len(x.split()) for x in mine[: best[0]]) >= min_words and p + best[0] > end:
            out.append((i, at, best[0], *best[1]))
            end = p + best[0]
    return out


@pytest.mark.parametrize("heavy", [1_000, 3])
def test_repeated_runs(spark, monkeypatch, heavy):
    monkeypatch.setattr(line_dedup, "HEAVY", heavy)
    rng = random.Random(heavy)
    pool = ["a b", "c", "d e f", "g h i j k", " a b ", ""]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))) for i in range(30)]
    passage = [f"line {i}" for i in range(37)]
    rows += [(40, "\n".join(passage)), (41, "\n".join(["x", *passage[5:], "c"])), (None, "\n".join(passage[:20] + ["y"] + passage[11:]))]
    rows += [(42, "\n".join(["same again"] * 23)), (43, None), (44, ""), (45, "once " * 3_000)]
    got = line_dedup.repeated_runs(docs_of(spark, rows), 4).collect()
    assert key(got) == key(brute_runs(rows, 4))
    assert any(r.n_lines == 32 for r in got)
    assert line_dedup.repeated_runs(docs_of(spark, rows).where("false")).count() == 0


def test_line_dedup_takes_repeated_rows_as_one(spark):
    rng = random.Random(16)
    pool = ["a b", "c", "d e f", "g h i j k", "l"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(30)]
    rows += [(50, "p q\nr s\nt"), (51, "new\np q\nr s\nend")]
    again = [r for r in rows if r[0] % 3 == 0]
    got = line_dedup.drop_repeated_lines(docs_of(spark, rows + again + again), 4).collect()
    want = brute_lines(rows, 4)
    assert key(got) == key(want + 2 * [r for r in want if r[0] % 3 == 0])


def test_hmm(spark, monkeypatch):
    monkeypatch.setattr(hmm, "FREQUENT", 20)
    monkeypatch.setattr(hmm, "FAN", 2)
    rng = random.Random(11)
    rows = [*EDGES] + [
        (100 + i, " ".join(rng.choice([f"a{rng.randint(0, 30)}", f"b{rng.randint(0, 3)}"]) for _ in range(rng.randint(1, 200))))
        for i in range(80)
    ]
    got = hmm.scored(docs_of(spark, rows)).collect()
    tokens = [(i, words_of(t) + ["\n"]) for i, t in rows]
    counts = Counter(w for i, t in tokens if i is not None and zlib.crc32(str(i).encode()) % 5 != 1 for w in t)
    total, types = sum(counts.values()), len(counts)
    want = sorted(
        (len(t), sum(counts[w] > 0 for w in t), total, round(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (types + 1))) for w in t), 6))
        for _, t in tokens
    )
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    held = [r for r in got if r.held_out]
    assert held and all(math.isfinite(r.score) and r.score < 0 for r in got)
    alone = hmm.scored(docs_of(spark, [(None, "a b")])).collect()
    assert alone[0].train_tokens == 0 and alone[0].n_known == 0


def test_baum_welch_never_gets_worse():
    rng = np.random.default_rng(12)
    spans = rng.integers(0, 40, (50, hmm.SPAN))
    sizes, first = np.full(50, hmm.SPAN), np.ones(50, dtype=bool)
    sizes[7] = 3
    prior = np.zeros(hmm.CLASSES)
    prior[:40] = 1 / 40
    model = hmm.random_model(prior)
    seen = []
    for _ in range(6):
        counts = hmm.expected(model, spans, sizes, first)
        s = hmm.STATES
        assert math.isclose(counts[s + s * s : -1].sum(), sizes.sum()) and math.isclose(counts[s : s + s * s].sum(), sizes.sum())
        seen.append(counts[-1])
        model = hmm.improved(counts, prior)
    assert seen[-1] > seen[0]


def test_baum_welch_runs_over_all_tokens_until_it_settles(spark, monkeypatch):
    monkeypatch.setattr(hmm, "SAMPLE_ROUNDS", 1)  # so that the start knows little
    rng = np.random.default_rng(14)
    rows, size = [], 0
    for i in range(120):
        n = int(rng.integers(1, 400))
        state = np.cumsum(rng.random(n) < 0.1) % hmm.STATES
        classes = np.where(rng.random(n) < 0.9, 5 * state + rng.integers(0, 5, n), rng.integers(0, 40, n)).astype(np.int16)
        rows.append((i, True, bytearray(classes.tobytes()), n))
        size += n
    rows.append((200, False, bytearray(np.zeros(50, dtype=np.int16).tobytes()), 50))
    tokens = spark.createDataFrame(rows, "row long, training boolean, classes binary, n_tokens long")
    prior = np.zeros(hmm.CLASSES)
    prior[:40] = 1 / 40
    _, trace = hmm.baum_welch(tokens, prior)
    gains = np.diff(trace) / size
    assert hmm.STATES >= 8 and len(trace) > 3
    assert gains[-1] < hmm.SETTLED and (gains[1:-1] >= hmm.SETTLED).all() and trace[-1] > trace[0]


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 16)
    rng = random.Random(13)
    rows = [(i, "w " * rng.randint(0, 60), None, rng.choice(["b", "a", "é", None])) for i in range(600)]
    rows += [(700, None, None, "a"), (700, None, None, "a"), (None, "x y z", None, "b"), (701, "q", None, "tiny"), (702, "", None, "void")]
    df = docs_of(spark, rows)
    got, again = mixing.mixed(df).collect(), mixing.mixed(df.repartition(5)).collect()
    plain = ("doc_id", "source", "size", "source_size", "target", "taken")
    assert key([[r[c] for c in plain] for r in got]) == key([[r[c] for c in plain] for r in again])
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
    sizes = defaultdict(int)
    for _, text, _, source in rows:
        sizes[source] += len(words_of(text))
    taken, target = defaultdict(int), {}
    for r in got:
        assert r.source_size == sizes[r.source]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert target["tiny"] == 3 and target["void"] == 0
    rest = sum(sizes.values()) - 3
    # a, b, tiny, void, é, null weigh 1, 2, 3, 1, 2, 3; tiny and void stop at three times their size
    assert all(math.isclose(target[s], rest * w / 8) for s, w in (("a", 1), ("b", 2), ("é", 2), (None, 3)))
    assert all(abs(taken[s] - target[s]) <= 30 for s in target)
    assert mixing.mixed(df.where("false")).count() == 0


def test_pivotal_keeps_expectations():
    sizes = np.array([8, 7, 5, 3, 2])
    chances = np.array([0.7, 0.4, 0.2, 0.5, 0.9])
    rng = np.random.default_rng(14)
    runs = np.array([mixing.trade(sizes, chances, rng.random(5)) for _ in range(20_000)])
    assert (((runs > 0) & (runs < 1)).sum(axis=1) <= 1).all()
    assert np.allclose(runs @ sizes, chances @ sizes) and np.allclose(runs.mean(axis=0), chances, atol=0.02)


def test_long_documents_are_settled_before_short_ones():
    rng = np.random.default_rng(15)
    sizes = np.sort(np.append(rng.integers(20, 200, 200), [9_000, 2_000]))[::-1]
    chances = np.append([0.35, 0.6], rng.uniform(0.2, 0.8, 200))
    runs = np.array([mixing.trade(sizes, chances, rng.random(len(sizes))) for _ in range(4_000)])
    still = (runs > 0) & (runs < 1)
    assert (still.sum(axis=1) <= 1).all() and not still[:, :2].any()
    assert np.allclose(runs @ sizes, chances @ sizes) and np.allclose(runs.mean(axis=0), chances, atol=0.04)
    # 80 documents cannot make up for a long one that is taken, so it is not; nothing makes up for a huge one
    sizes = np.append(9_000, np.sort(rng.integers(20, 200, 80))[::-1])
    few = mixing.trade(sizes, np.full(81, 0.3), rng.random(81))
    assert few[0] == 0.0 and abs(few @ sizes - 0.3 * sizes.sum()) < 1e-6
    alone = mixing.trade(np.append(10**6, sizes[1:]), np.full(81, 0.5), rng.random(81))
    assert 0.0 < alone[0] < 1.0


def test_mix_with_a_very_long_document(spark):
    rng = random.Random(16)
    rows = [(i, "w " * rng.choice([20, 200]), None, rng.choice("abc")) for i in range(600)]
    rows += [(1_000, "w " * 9_000, None, "a"), (1_001, "w " * 9_000, None, "b")]
    got = mixing.mixed(docs_of(spark, rows)).collect()
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 100 for s in target)
