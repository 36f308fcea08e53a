"""Encoding texts to piece ids of a SentencePiece model file, and back, by a streaming Viterbi search.

Places between characters are nodes, pieces are edges. In a unigram model a node keeps the edge with the best sum of
scores. In a byte-pair model the encoding of every prefix is unique, so a node keeps the one edge that fits: the piece
that, merged together with the last piece of the prefix before it, falls apart into just these two. Either way a node
has one backpointer. Only nodes within the longest piece's length of the front can be reached from ahead; whenever the
paths from all of them meet in one place, the ids before it are final, are handed on, and their nodes are let go.

Paths always meet between two characters that are neighbours in no piece (behind a word, before a comma). Texts are cut at
all such places first; equal parts of a batch are encoded once, and the ids of short parts are remembered.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from reviewloom.llm import words

MARK = "▁"
UNIGRAM, BPE = 1, 2  # fixed values of the model file's format
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
REMEMBERED, WORD = 60_000, 48  # words whose ids a task remembers, twice at most, and their greatest length
STRIDE = 64  # characters between looks for a common place
MODEL_BYTES = 64 << 20  # greatest size of a model file, as it is broadcast
TEXT_BYTES = 1 << 20
BLANK = b"\xff"  # stands for the mark among bytes, as it occurs in no UTF-8


def _bytes(char: str) -> bytes:
    return BLANK if char == MARK else char.encode("utf-8", "surrogatepass")


def read_model(path: str) -> dict:
    """Plain values of a model file: pieces, scores, kinds and flags."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        raw = f.read(MODEL_BYTES + 1)
    if len(raw) > MODEL_BYTES:
        raise ValueError(f"model file over {MODEL_BYTES} bytes")
    model.ParseFromString(raw)
    rules = model.normalizer_spec
    if model.trainer_spec.model_type not in (UNIGRAM, BPE):
        raise ValueError("only unigram and byte-pair models")
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
        raise ValueError("only models that keep texts as they are (identity normaliser)")
    if any(p.type == USER_DEFINED for p in model.pieces) or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("no user-defined pieces, no blanks as suffixes")
    return {
        "pieces": [p.piece for p in model.pieces], "scores": [p.score for p in model.pieces],
        "kinds": [p.type for p in model.pieces], "bpe": model.trainer_spec.model_type == BPE,
        "prefix": rules.add_dummy_prefix,
    }


def _text(raw: bytes) -> str:
    return raw.replace(BLANK, MARK.encode()).decode("utf-8", "surrogatepass")


class _Lookup:
    """A fixed map from 64-bit keys to numbers: tables addressed by the keys' high bits, each for what the last left over."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bits: int = 20):
        self.keys, self.values, self.tables = keys, values.astype(np.int64), []
        left, factor = np.arange(len(keys)), 0x9E3779B97F4A7C15
        while len(left):
            slot = (keys[left] * np.uint64(factor) >> np.uint64(64 - bits)).astype(np.int64)
            table = np.full(1 << bits, -1, dtype=np.int32)
            table[slot] = left
            self.tables.append((np.uint64(factor), np.uint64(64 - bits), table))
            left = left[table[slot] != left]
            factor, bits = (factor * 0xD1342543DE82EF95 + 2) % (1 << 64) | 1, 14

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where there is none."""
        out = np.full(len(keys), -1, dtype=np.int64)
        for factor, shift, table in self.tables:
            at = table[(keys * factor >> shift).astype(np.int64)]
            hit = np.flatnonzero(at >= 0)
            hit = hit[self.keys[at[hit]] == keys[hit]]
            out[hit] = self.values[at[hit]]
        return out


class _Batch:
    """The byte-pair search of ``Codec._short`` for many short words side by side."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, codec: Codec, pieces: list[str]):
        self.codec, self.size = codec, len(pieces)
        ids = codec.ids
        self.longest = codec.longest
        steps = np.full(self.longest + 1, self.BASE, dtype=np.uint64)
        steps[0] = 1
        self.powers = np.cumprod(steps, dtype=np.uint64)
        names = list(ids)
        width = max(map(len, names), default=1)
        hashes, lengths = self._hashes(names, width)
        values = np.array([ids[p] for p in names], dtype=np.int64)
        self.lookup = _Lookup(hashes[np.arange(len(names)), lengths], values)
        # one entry more stands for a character outside the vocabulary
        self.rank = np.zeros(self.size + 1, dtype=np.int64)
        self.left, self.right = (np.full(self.size + 1, -1, dtype=np.int64) for _ in range(2))
        self.stays = np.zeros(self.size + 1, dtype=bool)
        self.stays[self.size] = True
        joins: dict[int, int] = {}
        for p, i in ids.items():
            self.rank[i] = codec.rank[p]
            self.stays[i] = codec.stays(p)
            made = codec.split(p) if len(p) > 1 else None
            if made is not None:
                self.left[i], self.right[i] = ids.get(made[0], self.size), ids.get(made[1], self.size)
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is not None and b is not None:
                    joins[a * (self.size + 1) + b] = codec.rank[p]
        self.joined = _Lookup(np.array(list(joins), dtype=np.uint64), np.array(list(joins.values()), dtype=np.int64))

    def _hashes(self, texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every prefix of every text, (texts, width + 1), and the lengths."""
        lengths = np.array([len(x) for x in texts], dtype=np.int64)
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        chars = np.zeros((len(texts), width), dtype=np.uint64)
        chars[np.arange(width)[None, :] < lengths[:, None]] = words.mix(flat + np.uint64(1))
        out = np.zeros((len(texts), width + 1), dtype=np.uint64)
        for j in range(width):
            out[:, j + 1] = out[:, j] * self.BASE + chars[:, j]
        return out, lengths

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``Codec._apart`` for arrays of pieces that stay."""
        out = np.zeros(len(left), dtype=bool)
        open_, limit = np.arange(len(left)), np.full(len(left), self.size + 2, dtype=np.int64)
        left, right = left.copy(), right.copy()
        while len(open_):
            across = self.joined((left * (self.size + 1) + right).astype(np.uint64))
            keep = (across < 0) | (across >= limit)
            open_, left, right, limit = open_[keep], left[keep], right[keep], limit[keep]
            a, b = self.rank[left], self.rank[right]
            down_left, down_right = a > b, (a <= b) & (b > 0)
            settled = ~(down_left | down_right)
            out[open_[settled]] = True
            limit = np.where(down_left, a, b + 1)
            left, right = np.where(down_left, self.right[left], left), np.where(down_right, self.left[right], right)
            keep = ~settled
            open_, left, right, limit = open_[keep], left[keep], right[keep], limit[keep]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        lengths = np.array([len(x) for x in texts])
        order = np.argsort(-lengths, kind="stable")
        texts = [texts[i] for i in order]
        width = len(texts[0])
        sums, lengths = self._hashes(texts, width)
        last = np.full((len(texts), width + 1), -1, dtype=np.int64)
        back = np.zeros((len(texts), width + 1), dtype=np.int64)
        for j in range(1, width + 1):
            rows = np.arange(np.searchsorted(-lengths, -j, side="right"))
            for n in range(min(j, self.longest), 0, -1):
                i = j - n
                piece = self.lookup(sums[rows, j] - sums[rows, i] * self.powers[n])
                if n == 1:
                    piece[piece < 0] = self.size
                at = np.flatnonzero(piece >= 0)
                at = at[self.stays[piece[at]]]
                if i:
                    at = at[self.apart(last[rows[at], i], piece[at])]
                last[rows[at], j], back[rows[at], j] = piece[at], i
                rest = np.ones(len(rows), dtype=bool)
                rest[at] = False
                rows = rows[rest]
                if not len(rows):
                    break
        # read the paths from their ends
        at, path = lengths.copy(), []
        rows = np.arange(len(texts))
        while len(rows):
            here = at[rows]
            path.append((rows, here, last[rows, here]))
            at[rows] = back[rows, here]
            rows = rows[at[rows] > 0]
        row, place, piece = (np.concatenate(x) for x in zip(*path, strict=True))
        sort = np.lexsort((place, row))
        row, place, piece = row[sort], place[sort], piece[sort]
        bounds = np.searchsorted(row, np.arange(len(texts) + 1))
        raw = piece.astype(np.int32).tobytes()
        out = [raw[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for r in np.unique(row[piece == self.size]).tolist():
            out[r] = self._spelled(texts[r], place[bounds[r] : bounds[r + 1]], piece[bounds[r] : bounds[r + 1]])
        back_in_order = np.empty(len(order), dtype=np.int64)
        back_in_order[order] = np.arange(len(order))
        return [out[i] for i in back_in_order]

    def _spelled(self, text: str, places: np.ndarray, pieces: np.ndarray) -> bytes:
        """Ids of a word with characters outside the vocabulary."""
        ids = array("i")
        for place, piece in zip(places.tolist(), pieces.tolist(), strict=True):
            if piece < self.size:
                ids.append(piece)
            elif self.codec.bytes is not None:
                ids.extend(self.codec.bytes[b] for b in text[place - 1].encode("utf-8", "surrogatepass"))
            else:
                ids.append(self.codec.unknown)
        return ids.tobytes()


class Codec:
    """Encoder and decoder for one model."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[int], bpe: bool, prefix: bool, halves=None):
        self.bpe, self.prefix = bpe, prefix
        self.ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == NORMAL}
        self.scores = scores
        self.longest = max(map(len, self.ids), default=1)
        self.unknown = next((i for i, k in enumerate(kinds) if k == UNKNOWN), 0)
        bytes_ = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == BYTE}
        self.bytes = bytes_ if len(bytes_) == 256 else None
        self.penalty = min((scores[i] for i in self.ids.values()), default=0.0) - 10.0
        self.out = [
            bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN
            else p.replace(MARK, " ").encode("utf-8", "surrogatepass")
            for p, k in zip(pieces, kinds, strict=True)
        ]
        # last byte of one character, first byte of the next: pairs that occur inside pieces
        self.inside = np.zeros((256, 256), dtype=bool)
        for p in self.ids:
            for x, y in zip(p, p[1:]):
                self.inside[_bytes(x)[-1], _bytes(y)[0]] = True
        # order in which merges are done; single characters need none
        several = sorted((p for p in self.ids if len(p) > 1), key=lambda p: -scores[self.ids[p]])
        self.rank = {p: 0 for p in self.ids if len(p) == 1} | {p: r for r, p in enumerate(several, 1)}
        by_score: dict[float, set[bool]] = {}
        ties = 0
        for p in several:
            run_of_marks = not p.strip(MARK)
            seen = by_score.setdefault(scores[self.ids[p]], set())
            ties += bool(seen) and not (run_of_marks and seen == {True})
            seen.add(run_of_marks)
        self.ranked = not ties  # but for runs of marks, no two pieces are merged at the same rank
        self.halves: dict[str, tuple[str, str] | None] = {} if halves is None else halves
        self.fits: dict[tuple[str, str], bool] = {}
        self.young: dict[int, bytes] = {}
        self.old: dict[int, bytes] = {}
        self.batch = _Batch(self, pieces) if bpe and self.ranked else None

    def merged(self, text: str) -> list[str]:
        """Byte-pair merging as defined: best score first, then the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                piece = self.ids.get(parts[i] + parts[i + 1])
                if piece is not None and (best is None or self.scores[piece] > best):
                    best, at = self.scores[piece], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merging makes this one; None if merging its characters never makes it."""
        known = self.halves.get(piece, ())
        if known == ():
            parts, known = list(piece), None
            while len(parts) > 1:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    found = self.ids.get(parts[i] + parts[i + 1])
                    if found is not None and (best is None or self.scores[found] > best):
                        best, at = self.scores[found], i
                if at < 0:
                    break
                known = (parts[at], parts[at + 1]) if len(parts) == 2 else None
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.halves[piece] = known
        return known

    def stays(self, piece: str) -> bool:
        """Whether the piece's characters merge into the piece."""
        return len(piece) == 1 or self.split(piece) is not None

    def _apart(self, left: str, right: str) -> bool:
        """Whether two pieces that stay are never merged across their border.

        Going back through the merges that made them, latest first: they are, if at some point the border's own
        merge would have come before the next merge on either side. On equal rank the left one comes first.
        """
        if not self.ranked or MARK * 2 in left + right:
            return self.merged(left + right) == [left, right]
        rank, limit = self.rank, len(self.rank) + 2
        while True:
            across = rank.get(left + right)
            if across is not None and across < limit:
                return False
            a, b = rank.get(left, 0), rank.get(right, 0)
            if a > b:
                limit, left = a, self.split(left)[1]
            elif b:
                limit, right = b + 1, self.split(right)[0]
            else:
                return True

    def goes_with(self, left: str, right: str) -> bool:
        """Whether the second piece can follow the first (or begin a text, after none)."""
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > REMEMBERED:
                self.fits.clear()
            known = self.fits[key] = self.stays(right) and (not left or self._apart(left, right))
        return known

    def edge(self, text: str, j: int, base: int, nodes: dict[int, tuple[int, float]]) -> tuple[int, float]:
        """Backpointer and score of node ``j``."""
        best, ids, bpe = None, self.ids, self.bpe
        for i in range(max(base, j - self.longest), j):
            piece = text[i:j]
            if piece not in ids and j - i > 1:
                continue
            if bpe:
                if self.goes_with(text[nodes[i][0] : i], piece):
                    return i, 0.0
            else:
                known = ids.get(piece)
                score = nodes[i][1] + (self.penalty if known is None else self.scores[known])
                if best is None or score > best[1]:
                    best = (i, score)
        if best is None:
            raise ValueError(f"no piece ends at {j}")
        return best

    def segments(self, text: str) -> Iterator[str]:
        """Pieces of the text in order. Nodes are held for a window only."""
        nodes: dict[int, tuple[int, float]] = {0: (0, 0.0)}
        done = 0
        for j in range(1, len(text) + 1):
            nodes[j] = self.edge(text, j, max(done - self.longest, 0) if done else 0, nodes)
            if j % STRIDE == 0 or j == len(text):
                open_ = {j} if j == len(text) else set(range(max(j - self.longest + 1, done), j + 1))
                while len(open_) > 1:
                    last = max(open_)
                    open_.discard(last)
                    open_.add(max(nodes[last][0], done))
                    if open_ == {done}:
                        break
                meet = open_.pop()
                if meet > done:
                    cuts, at = [], meet
                    while at > done:
                        cuts.append(at)
                        at = nodes[at][0]
                    for cut in reversed(cuts):
                        yield text[done:cut]
                        done = cut
                    # what lies before can still be a left neighbour, not more
                    for i in [i for i in nodes if i < done - 2 * self.longest]:
                        del nodes[i]

    def _ids(self, text: str) -> array:
        out = array("i")
        for piece in self.segments(text):
            known = self.ids.get(piece)
            if known is not None:
                out.append(known)
            elif self.bytes is not None:
                out.extend(self.bytes[b] for b in piece.encode("utf-8", "surrogatepass"))
            else:
                out.append(self.unknown)
        return out

    def _short(self, word: str) -> bytes:
        """Ids of a short word by the same search, all of whose nodes fit in one window."""
        ids, fits, longest = self.ids, self.fits, self.longest
        n = len(word)
        ends, back = [""] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            for i in range(j - longest if j > longest else 0, j):
                piece = word[i:j]
                if piece in ids or j - i == 1:
                    key = (ends[i], piece)
                    if fits[key] if key in fits else self.goes_with(*key):
                        ends[j], back[j] = piece, i
                        break
        out = []
        while n:
            piece = ends[n]
            known = ids.get(piece)
            if known is not None:
                out.append(known)
            elif self.bytes is not None:
                out.extend(self.bytes[b] for b in reversed(piece.encode("utf-8", "surrogatepass")))
            else:
                out.append(self.unknown)
            n = back[n]
        out.reverse()
        return array("i", out).tobytes()

    def forget(self) -> None:
        self.old, self.young = {}, {}

    def _remember(self, key: int, ids: bytes) -> None:
        if len(self.young) >= REMEMBERED:
            self.old, self.young = self.young, {}
        self.young[key] = ids

    def _parts(self, keys: list[int], raw: list[bytes]) -> list[bytes]:
        """Ids of distinct parts; short ones are remembered by their hash."""
        out: list[bytes | None] = []
        short, long = [], []
        for i, key in enumerate(keys):
            ids = self.young.get(key)
            if ids is None:
                ids = self.old.get(key)
                if ids is not None:
                    self._remember(key, ids)
                else:
                    (short if len(raw[i]) <= WORD else long).append(i)
            out.append(ids)
        for i in long:
            out[i] = self._ids(_text(raw[i])).tobytes()
        plain = [i for i in short if self.batch is not None and BLANK * 2 not in raw[i]]
        if plain:
            for i, ids in zip(plain, self.batch.encode([_text(raw[i]) for i in plain]), strict=True):
                out[i] = ids
        for i in short:
            if out[i] is None:
                part = _text(raw[i])
                out[i] = self._short(part) if self.bpe else self._ids(part).tobytes()
            self._remember(keys[i], out[i])
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and where each text's begin. Null and empty texts have none.

        Unknown neighbours share one id, unless the model spells them in bytes.
        """
        data, offsets = words.text_bytes(texts)
        if MARK.encode() in data.tobytes():
            data, offsets = words.text_bytes(pa.compute.replace_substring(texts, MARK, " "))
        full = np.diff(offsets) > 0
        if not full.any():
            return np.empty(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
        if self.prefix:
            data = np.insert(data, offsets[:-1][full], 0x20)
            offsets = offsets + np.concatenate([[0], np.cumsum(full)])
        data = np.where(data == 0x20, np.uint8(BLANK[0]), data)
        cut = np.ones(len(data), dtype=bool)
        cut[1:] = ~self.inside[data[:-1], data[1:]] & ((data[1:] & 0xC0) != 0x80) | (data[1:] == BLANK[0]) & ~self.inside[data[:-1], BLANK[0]]
        cut[offsets[:-1][full]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        keys, first, which = np.unique(words.hash_ranges(data, starts, ends), return_index=True, return_inverse=True)
        raw = data.tobytes()
        spans = zip(starts[first].tolist(), ends[first].tolist(), strict=True)
        coded = self._parts(keys.tolist(), [raw[a:b] for a, b in spans])
        each = np.frombuffer(b"".join(coded), dtype=np.int32)
        size = np.array([len(c) // 4 for c in coded], dtype=np.int64)
        begin = np.cumsum(size) - size
        sizes = size[which]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        ids = each[np.repeat(begin[which] - bounds[:-1], sizes) + np.arange(bounds[-1])]
        text = bounds[np.searchsorted(starts, offsets)]
        if self.bytes is None:
            fresh = np.ones(len(ids), dtype=bool)
            fresh[1:] = (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)
            fresh[text[:-1][np.diff(text) > 0]] = True
            text = np.concatenate([[0], np.cumsum(fresh)])[text]
            ids = ids[fresh]
        return ids, text

    def decode(self, ids) -> str:
        """Text of a list of ids; bytes that are no UTF-8 become the replacement character."""
        text = b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def with_halves(model: dict) -> dict:
    """The model with the last merge of every piece, so that executors need not work them out."""
    return {**model, "halves": Codec(**model).halves}


def _codec(shared) -> Codec:
    """The worker's codec for a broadcast model, kept beside the model; what it remembers is a task's own."""
    held = shared.value
    if "codec" not in held:
        held["codec"] = Codec(**held["model"])
    return held["codec"]


def _encode(shared, check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            for part in words.chunks(batch, limit=TEXT_BYTES):
                ids, bounds = codec.encode(part.column("text"))
                columns = [
                    part.column("doc_id").cast(pa.int64()), pa.array(np.diff(bounds).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)),
                ]
                if check:
                    listed, texts = ids.tolist(), part.column("text").to_pylist()
                    columns.append(pa.array([
                        codec.decode(listed[a:b]) == (t or "").replace(MARK, " ")
                        for t, a, b in zip(texts, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
                    ]))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_ids", "ids", "restored"][: len(columns)])
        codec.forget()

    return run


def _decode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                texts = [None if ids is None else codec.decode(ids) for ids in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"]
                )

    return run


def encoded(docs: DataFrame, model_path: str, check: bool = False) -> DataFrame:
    """(doc_id, n_ids, ids) for every row of ``docs`` (doc_id, text), with ``check`` also whether decoding restores the text.

    Null and empty texts have no ids. The mark that stands for blanks in pieces, where it occurs in a text, is read as a
    blank and restored as one; all else is restored as it was. Characters outside the vocabulary
    are spelled in byte pieces, if the model has them. Repeated rows give repeated results. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast({"model": with_halves(read_model(model_path))})
    schema = "doc_id long, n_ids long, ids array<int>" + (", restored boolean" if check else "")
    return docs.select("doc_id", "text").mapInArrow(_encode(shared, check), schema)


def decoded(rows: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) for every row of ``rows`` (doc_id, ids); null ids give a null text."""
    shared = rows.sparkSession.sparkContext.broadcast({"model": read_model(model_path)})
    return rows.select("doc_id", "ids").mapInArrow(_decode(shared), "doc_id long, text string")
