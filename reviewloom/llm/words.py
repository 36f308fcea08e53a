"""Words of whole texts as arrays: places, hashes and distinct shingles, for code that runs inside tasks.

A word is a run of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return.
Those bytes never occur inside a UTF-8 sequence, so bytes and characters give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACES = (0x20, *range(0x09, 0x0E))
CHUNK_BYTES = 1 << 20  # text handled at a time; one longer text is handled alone
BLOCK_BYTES = 1 << 20  # bytes whose prefix sums are held at a time

IS_WORD = np.ones(256, dtype=bool)
IS_WORD[list(SPACES)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

BASE = 0x9E3779B97F4A7C15  # odd, so that its powers can be inverted modulo 2**64
MIX_1, MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
LEFT, RIGHT, ALONE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
END = np.uint64(0x5851F42D4C957F2D)  # stands for the end of a text among word hashes

_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and ``BASE**-i`` modulo 2**64 for i below n."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of each 64-bit number over the result."""
    x = x ^ (x >> np.uint64(33))
    x = x * MIX_1
    x ^= x >> np.uint64(29)
    x *= MIX_2
    x ^= x >> np.uint64(32)
    return x


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have at most ``limit`` bytes together, or one row each."""
    if batch.num_rows == 0:
        return
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each text starts (one more entry: the end); null counts as empty."""
    texts = pa.compute.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of every word; a word never reaches over the end of its text."""
    inside = IS_WORD[data]
    begins, closes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of bytes. Starts ascend; ranges may overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        first = starts[at]
        to = max(at + 1, int(np.searchsorted(starts, first + BLOCK_BYTES)))
        last = int(ends[at:to].max())
        power, inverse = powers(last - first + 1)
        sums = np.zeros(last - first + 1, dtype=np.uint64)
        np.cumsum((data[first:last].astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
        a, b = starts[at:to] - first, ends[at:to] - first
        out[at:to] = mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64) * LEFT)
        at = to
    return out


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every word after lower-casing A to Z, in order."""
    data, offsets = text_bytes(texts)
    data = LOWER[data]
    starts, ends, text = word_places(data, offsets)
    return hash_ranges(data, starts, ends), text


def shingles(texts: pa.Array, width: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text's runs of ``width`` neighbouring words, sorted, and the bounds of each text.

    A text of fewer words has the whole sequence as its only shingle; a text without words has none.
    """
    hashes, text = word_hashes(texts)
    if not len(hashes):
        return hashes, np.zeros(len(texts) + 1, dtype=np.int64)
    sizes = np.bincount(text, minlength=len(texts))
    firsts = np.cumsum(sizes) - sizes
    grams, short = hashes, [mix(hashes[firsts[sizes == 1]] * ALONE)]
    owners = [np.flatnonzero(sizes == 1)]
    same = sizes[text] > 1  # at width one, single words are among ``short``
    for k in range(2, width + 1):
        n = max(0, len(hashes) - k + 1)
        same = text[k - 1 :] == text[:n]
        grams = mix(grams[:n] * LEFT + hashes[k - 1 :] * RIGHT)
        whole = np.flatnonzero(sizes == k)
        if k < width:
            short.append(mix(grams[firsts[whole]] * ALONE + np.uint64(k)))
            owners.append(whole)
    found = np.concatenate([grams[same], *short])
    owner = np.concatenate([text[: len(same)][same], *owners])
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    fresh = np.ones(len(found), dtype=bool)
    fresh[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    found, owner = found[fresh], owner[fresh]
    return found, np.searchsorted(owner, np.arange(len(texts) + 1))
