"""Texts whose sets of word n-grams overlap almost wholly, found by signature trees.

A text is the set of its distinct shingles, held as 64-bit hashes. Texts with the same set form a class, of which one
goes on. A signature tree is built over members ordered so that likely partners are neighbours. Each leaf, and each
node above, holds the OR of its members' token bitmaps, their smallest and largest set size, and the most tokens that
any member loses to bits it uses twice. Two nodes can hold a link only if the sizes fit and

    popcount(OR of one AND OR of other) + least of the two losses

reaches the overlap that the similarity asks of their smallest sizes: tokens that two sets share have their bits set in both
ORs. A dual traversal starts with the root against itself, drops pairs of nodes that fail, and goes down to pairs of
members, whose full sets are compared. Pairs of nodes whose members already lie in one component are dropped as well,
so that a large group of copies takes about as many comparisons as it has members, not pairs.

One tree over all texts would meet itself in one task, so there is a forest. Tokens are counted over all sets, and sets are put
in one global order of tokens, rare ones first. A text belongs to the trees of its first n - ceil(n * percent / 100) + 1
tokens, as any link shares one of those; if no other set has any of these, the text is linked with nothing. Sizes are
cut into bands so that a link reaches into the next band at most, and a tree holds one token and two neighbouring bands:
no link is lost between trees. Two texts that share many tokens are compared in one tree only, that of the first token they
share, and only if their first tokens leave room for the similarity; a tree whose members have all met before, or lie in one
component, is not grown. To start with, trees of only the first ``FIRST`` shared tokens of each text join most of what
belongs together. Of trees with the same members one is grown. A tree of very many members is cut at its top into blocks,
which meet pair by pair in tasks of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm import words
from reviewloom.llm.graph import components
from reviewloom.llm.near_dups import digests_of
from reviewloom.llm.scope import fields
from reviewloom.operators.cells import MOST_PARTITIONS, by_cell
from reviewloom.session import durable

WIDTH = 5  # words of a shingle, unless stated otherwise
TREE_TEXTS, TREE_TOKENS = 2_000, 1_000_000  # of a block of a large tree, on average
LEAF, FAN = 16, 8  # members of a leaf, children of a node
LEAST_BITS, BITS_PER_TOKEN, TREE_BYTES = 256, 16, 4 << 20  # width of bitmaps, and what those of one level may take
PAIR_BYTES = 8 << 20  # bitmaps compared at a time
FIRST = 4  # shared tokens of a text whose trees are grown first
BUCKET_TOKENS = 4_000_000  # tokens counted together, on average
SENT_TOKENS = 2_000_000  # tokens that a task sorts by bucket at a time
MET_COLUMNS = 4_096  # tokens of a product of members and earlier tokens
OWN = ("doc_id", "text")
SET_SCHEMA = "doc_id long, n_shingles long, digest binary"
BROADCAST_ROWS = 300_000  # rows of a few numbers up to which a table of them is broadcast
ROW = ("doc_id", "text_key")


def least_overlap(n_a, n_b, percent: int):
    """Shared tokens that two sets of these sizes need."""
    return -(-percent * (n_a + n_b) // (100 + percent))


def first_tokens(sizes: np.ndarray, percent: int) -> np.ndarray:
    """How many of a set's tokens, in the global order, one of which any link shares."""
    return np.where(sizes > 0, sizes - (-(-percent * sizes // 100)) + 1, 0)


def _among(found: np.ndarray, listed: np.ndarray) -> np.ndarray:
    if not len(listed):
        return np.zeros(len(found), dtype=bool)
    return listed[np.minimum(np.searchsorted(listed, found), len(listed) - 1)] == found


def _sets(width: int):
    """Size and digest of each text's set; other columns come along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch):
                found, bounds = words.shingles(part.column("text"), width)
                sizes = np.diff(bounds)
                full = sizes > 0
                digests: list[bytes | None] = [None] * part.num_rows
                if full.any():
                    tight = np.append(bounds[:-1][full], bounds[-1])
                    for i, d in zip(np.flatnonzero(full), digests_of(found, tight), strict=True):
                        digests[i] = d.tobytes()
                rest = [c for c in part.schema.names if c not in OWN]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(sizes.astype(np.int64)), pa.array(digests, pa.binary()),
                     *(part.column(c) for c in rest)],
                    names=["doc_id", "n_shingles", "digest", *rest],
                )

    return run


def _packed(names: list[str], group: np.ndarray, node: np.ndarray, size: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """One row per group: its nodes, their sizes, how many entries each has, and the entries, all as bytes. Rows come sorted by group
    and node."""
    if not len(group):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), *[pa.array([], pa.binary())] * (len(names) - 1)], names=names)
    begins = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (group[1:] != group[:-1])))
    counts = np.diff(np.append(begins, len(group))).astype(np.int32)
    used, first = np.unique(group, return_index=True)
    bounds = np.append(first, len(group))
    runs = np.searchsorted(begins, bounds)
    values = [(node[begins], runs), (size[begins], runs), (counts, runs), *((c, bounds) for c in columns)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(used.astype(np.int64)),
            *(pa.array([x[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()) for x, at in values),
        ],
        names=names,
    )


def _unpacked(parts: list[tuple], *kinds: type) -> list[np.ndarray]:
    """Node, size and entries of all rows of a group, one value per entry."""
    def joined(k, kind):
        return np.concatenate([np.frombuffer(p[k], dtype=kind) for p in parts])

    counts = joined(2, np.int32)
    return [np.repeat(joined(0, np.int64), counts), np.repeat(joined(1, np.int32), counts), *(joined(3 + k, kind) for k, kind in enumerate(kinds))]


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows sorted by their first column, without it, as one list per value."""
    group, parts = None, []
    for batch in batches:
        binary = [pa.types.is_binary(kind) for kind in batch.schema.types]
        for i in range(batch.num_rows):
            # bytes are looked at where they lie, not copied
            row = tuple(c[i].as_buffer() if b else c[i].as_py() for c, b in zip(batch.columns, binary, strict=True))
            if row[0] != group:
                if parts:
                    yield parts
                group, parts = row[0], []
            parts.append(row[1:])
    if parts:
        yield parts


SENT = ["bucket", "nodes", "sizes", "counts", "tokens"]
SHARED = ["target", "nodes", "sizes", "counts", "tokens", "texts"]


def _sent(width: int, buckets: int):
    """Tokens of (node, text) by bucket."""

    def rows(tokens: list[np.ndarray], nodes: list[np.ndarray], sizes: list[np.ndarray]) -> pa.RecordBatch:
        token, node, size = np.concatenate(tokens), np.concatenate(nodes), np.concatenate(sizes)
        tokens.clear()
        bucket = ((token >> np.uint64(33)).astype(np.int64) % buckets).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket, token = bucket[order], token[order]
        owner = np.repeat(np.arange(len(size), dtype=np.int32), size)[order]
        del order
        return _packed(SENT, bucket, node[owner], size[owner], token)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, nodes, sizes, held = [], [], [], 0
        for batch in batches:
            for part in words.chunks(batch):
                found, bounds = words.shingles(part.column("text"), width)
                size = np.diff(bounds)
                tokens.append(found)
                nodes.append(part.column("node").to_numpy())
                sizes.append(size.astype(np.int32))
                held += len(found)
                if held >= SENT_TOKENS:
                    yield rows(tokens, nodes, sizes)
                    tokens, nodes, sizes, held = [], [], [], 0
        if held:
            yield rows(tokens, nodes, sizes)

    return run


def _shared(targets: int):
    """Rows sorted by bucket: the tokens that several nodes have, and how many have them, by a hash of the node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _by_group(batches):
            node, size, token = _unpacked(parts, np.uint64)
            order = np.lexsort((node, token))
            token, node, size = token[order], node[order], size[order]
            fresh = np.append(True, (token[1:] != token[:-1]) | (node[1:] != node[:-1]))  # equal rows of a text count once
            token, node, size = token[fresh], node[fresh], size[fresh]
            begins = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            texts = np.diff(np.append(begins, len(token)))
            texts = np.repeat(texts, texts).astype(np.int32)
            several = np.flatnonzero(texts > 1)
            target = (words.mix(node.astype(np.uint64)) % np.uint64(targets)).astype(np.int64)
            order = several[np.lexsort((node[several], target[several]))]
            yield _packed(SHARED, target[order], node[order], size[order], token[order], texts[order])

    return run


def _prefixes(percent: int):
    """Rows sorted by target: each node's shared tokens among the first of its set, rarest first, and how many come before
    them. A set with more tokens of its own than the similarity lets it lack is linked with nothing and left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _by_group(batches):
            node, size, token, texts = _unpacked(parts, np.uint64, np.int32)
            order = np.lexsort((token, texts, node))
            node, size, token, texts = node[order], size[order].astype(np.int64), token[order], texts[order]
            begins = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            counts = np.diff(np.append(begins, len(node)))
            alone = size[begins] - counts  # what no other set has comes before all others
            room = np.clip(first_tokens(size[begins], percent) - alone, 0, counts)
            kept = np.arange(len(node)) - np.repeat(begins, counts) < np.repeat(room, counts)
            used = room > 0
            offsets = np.concatenate([[0], np.cumsum(room[used])])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(token[kept].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(node[begins][used]), pa.array(size[begins][used]), pa.array(alone[used]), lists,
                    pa.array(texts[(begins + room - 1)[used]].astype(np.int64)),
                ],
                names=["node", "n", "alone", "prefix", "last_texts"],
            )

    return run


def _firsts(classes: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """(node, n, alone, prefix, last_texts) for every set whose first tokens are not all its own.

    Tokens travel once, packed by bucket; what goes on to the sets are those that several sets have.
    """
    total = classes.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, math.ceil(total / BUCKET_TOKENS))
    reps = classes.select("node", "rep.doc_id", "rep.text_key")
    sent = texts.join(_small(reps), list(ROW)).select("node", "text")
    sent = sent.mapInArrow(_sent(width, buckets), "bucket long, nodes binary, sizes binary, counts binary, tokens binary")
    # a bucket is a task of its own: by hash, some tasks would get several
    sent = by_cell(sent.withColumn("bucket", F.col("bucket").cast("int")), buckets, "bucket").sortWithinPartitions("bucket")
    rows = sent.mapInArrow(_shared(buckets), "target long, nodes binary, sizes binary, counts binary, tokens binary, texts binary")
    rows = by_cell(rows.withColumn("target", F.col("target").cast("int")), buckets, "target").sortWithinPartitions("target")
    schema = "node long, n long, alone long, prefix array<long>, last_texts long"
    return durable(rows.mapInArrow(_prefixes(percent), schema))


def _tokens(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch):
                found, bounds = words.shingles(part.column("text"), width)
                raw = [found[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(raw, pa.binary())], names=["node", "tokens"])

    return run


class Level:
    """Nodes of one level: OR of bitmaps, smallest and largest size, most tokens lost to shared bits, components, sides."""

    def __init__(self, bits, low, high, lost, first, last, sides):
        self.bits, self.low, self.high, self.lost = bits, low, high, lost
        self.first, self.last, self.sides = first, last, sides

    def above(self, fan: int) -> Level:
        at = np.arange(0, len(self.low), fan)
        return Level(
            np.bitwise_or.reduceat(self.bits, at, axis=0), np.minimum.reduceat(self.low, at), np.maximum.reduceat(self.high, at),
            np.maximum.reduceat(self.lost, at), np.minimum.reduceat(self.first, at), np.maximum.reduceat(self.last, at),
            np.bitwise_or.reduceat(self.sides, at),
        )

    def fits(self, x: np.ndarray, y: np.ndarray, percent: int, sided: bool) -> np.ndarray:
        """Which of the pairs of nodes (x, y) may hold a link between different components (and sides)."""
        keep = (100 * self.high[x] >= percent * self.low[y]) & (100 * self.high[y] >= percent * self.low[x])
        keep &= (np.minimum(self.first[x], self.first[y]) != np.maximum(self.last[x], self.last[y]))
        if sided:
            keep &= ((self.sides[x] & 1) & (self.sides[y] >> 1) | (self.sides[x] >> 1) & (self.sides[y] & 1)) > 0
        rows = np.flatnonzero(keep)
        need = least_overlap(self.low[x], self.low[y], percent)
        step = max(1, PAIR_BYTES // (8 * self.bits.shape[1]))
        for at in range(0, len(rows), step):
            r = rows[at : at + step]
            shared = np.bitwise_count(self.bits[x[r]] & self.bits[y[r]]).sum(axis=1, dtype=np.int64)
            keep[r] = shared + np.minimum(self.lost[x[r]], self.lost[y[r]]) >= need[r]
        return keep


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, words of 64 bits): each set's tokens as bits. The width follows the largest set, as far as memory allows."""
    width = LEAST_BITS
    while width < BITS_PER_TOKEN * max(map(len, sets)) and width * len(sets) // 4 <= TREE_BYTES:
        width *= 2
    flags = np.zeros((len(sets), width), dtype=bool)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flags[owner, (np.concatenate(sets) >> np.uint64(20)).astype(np.int64) & (width - 1)] = True
    return np.packbits(flags, axis=1).view(np.uint64)


def links_in(sets: list[np.ndarray], comps: np.ndarray, sides: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (i, j) that join the given components: a spanning forest of all links between members (of different
    sides, if both sides occur). ``sets`` are sorted arrays of distinct tokens and not empty."""
    sided = len(np.unique(sides)) > 1
    size = np.array([len(s) for s in sets], dtype=np.int64)
    order = np.lexsort((size, np.array([s[0] for s in sets])))
    bits = bitmaps([sets[i] for i in order])
    label, side, size = comps[order].copy(), sides[order], size[order]
    lost = size - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    members = Level(bits, size, size, lost, label, label, np.int64(1) << side)
    levels = [members.above(LEAF)]
    while len(levels[-1].low) > 1:
        levels.append(levels[-1].above(FAN))
    x = y = np.zeros(1, dtype=np.int64)
    for depth in range(len(levels) - 1, 0, -1):
        keep = levels[depth].fits(x, y, percent, sided)
        x, y = x[keep], y[keep]
        below = len(levels[depth - 1].low)
        child = np.arange(FAN)
        left, right = (x[:, None, None] * FAN + child[:, None]), (y[:, None, None] * FAN + child[None, :])
        left, right = (s.reshape(-1) for s in np.broadcast_arrays(left, right))
        inside = (left < below) & (right < below) & (left <= right)
        x, y = left[inside], right[inside]
    keep = levels[0].fits(x, y, percent, sided)
    x, y = x[keep], y[keep]
    nearest = np.argsort(y - x, kind="stable")  # neighbours first: they join most of a group
    found = []
    for a, b in zip(x[nearest], y[nearest], strict=True):
        i, j = np.arange(a * LEAF, min(a * LEAF + LEAF, len(size))), np.arange(b * LEAF, min(b * LEAF + LEAF, len(size)))
        if label[i[0]] == label[j[0]] and (label[i] == label[i[0]]).all() and (label[j] == label[i[0]]).all():
            continue
        members.first = members.last = label
        p, q = (s.reshape(-1) for s in np.meshgrid(i, j, indexing="ij"))
        once = p < q
        p, q = p[once], q[once]
        possible = members.fits(p, q, percent, sided)
        for u, v in zip(p[possible], q[possible], strict=True):
            if label[u] == label[v]:
                continue
            one, other = sets[order[u]], sets[order[v]]
            if len(one) > len(other):
                one, other = other, one
            both = int(_among(one, other).sum())
            if 100 * both >= percent * (len(one) + len(other) - both):
                found.append((int(order[u]), int(order[v])))
                label[label == label[v]] = label[u]
    return found


def _by_tree(keys: int, grow, schema: str):
    """Rows sorted by tree, the first ``keys`` columns: what ``grow`` makes of the rows of each tree, when its last has come."""
    fields_ = [f.split() for f in schema.split(", ")]

    def batch(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([f[k] for f in found], pa.int64()) for k in range(len(fields_))], names=[name for name, _ in fields_]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, rows = None, []
        for part in batches:
            out: list[tuple] = []
            columns = [part.column(i) if pa.types.is_list(part.column(i).type) else part.column(i).to_pylist() for i in range(part.num_columns)]
            for row in zip(*columns, strict=True):
                if row[:keys] != tree:
                    out += grow(tree, rows)
                    tree, rows = row[:keys], []
                rows.append(row[keys:])
            yield batch(out)
        yield batch(list(grow(tree, rows)))

    return run


def _grown(percent: int):
    """Links (a, b) of a tree from its members (node, comp, side, tokens)."""

    def grow(tree: tuple, rows: list[tuple]) -> Iterator[tuple[int, int]]:
        unique = {(r[0], r[2]): r for r in rows}  # a text that occurs in several equal rows is one member
        if len(unique) < 2:
            return
        rows = [unique[k] for k in sorted(unique)]
        nodes = [r[0] for r in rows]
        _, comps = np.unique(np.array([r[1] for r in rows]), return_inverse=True)
        sets = [np.frombuffer(r[3], dtype=np.uint64) for r in rows]
        for i, j in links_in(sets, comps, np.array([r[2] for r in rows]), percent):
            yield nodes[i], nodes[j]

    return grow


def shared_counts(lists: list[np.ndarray]) -> np.ndarray:
    """How many tokens each two lists of distinct tokens share, as a matrix."""
    n = len(lists)
    owner = np.repeat(np.arange(n), [len(e) for e in lists])
    _, column, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column, width = owner[keep], number[column[keep]], int(shared.sum())
    out = np.zeros((n, n), dtype=np.float32)
    for at in range(0, width, MET_COLUMNS):
        here = (column >= at) & (column < at + MET_COLUMNS)
        part = np.zeros((n, min(MET_COLUMNS, width - at)), dtype=np.float32)
        part[owner[here], column[here] - at] = 1.0
        out += part @ part.T
    return out


def may_link(first: list[np.ndarray], last_texts: np.ndarray, alone: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Which two sets may be linked, by their sizes and first tokens (in the global order), as a matrix.

    ``first`` are the shared ones of a set's first tokens, ``alone`` counts those before them that no other set has. Of two
    lists of first tokens one ends first. All tokens up to there are known of both sets, so what this list does not
    share with the other one is missing from the other set, which may not lack more than the sizes allow.
    """
    last = np.array([f[-1] for f in first]).view(np.uint64)
    place = np.empty(len(first), dtype=np.int64)
    place[np.lexsort((last, last_texts))] = np.arange(len(first))
    length = alone + np.array([len(f) for f in first])
    missing = length[:, None] - shared_counts(first)
    allowed = n[:, None] - least_overlap(n[:, None], n[None, :], percent)
    fits = missing <= allowed
    fits = np.where(place[:, None] <= place[None, :], fits, fits.T)
    return fits & (100 * n[:, None] >= percent * n[None, :]) & (100 * n[None, :] >= percent * n[:, None])


def _new_pairs(percent: int, begun: int):
    """Members of a tree that may be linked with another one that they meet for the first time there: from (node, comp, side, n,
    home, place, alone, last_texts, prefix) to (tree, i, j, node, comp, side). Places below ``begun`` have been dealt with."""

    def grow(tree: tuple, rows: list[tuple]) -> Iterator[tuple]:
        if len(rows) < 2:
            return
        node, comp, side, n, home, place, alone, last_texts = (np.array([r[k] for r in rows]) for k in range(8))
        first = [r[8].values.to_numpy() for r in rows]
        new = comp[:, None] != comp[None, :]
        new &= home[:, None] | home[None, :]  # the other ones meet in the band below
        new &= (place[:, None] >= begun) | (place[None, :] >= begun)  # the other ones met to start with
        if len(np.unique(side)) > 1:
            new &= side[:, None] != side[None, :]
        if new.any():
            new &= shared_counts([f[:k] for f, k in zip(first, place, strict=True)]) == 0
        if new.any():
            new &= may_link(first, last_texts, alone, n, percent)
        for k in np.flatnonzero(new.any(axis=1)):
            yield *tree, int(node[k]), int(comp[k]), int(side[k])

    return grow


def _small(df: DataFrame) -> DataFrame:
    """The table, to be broadcast if it has few enough rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _forest(firsts: DataFrame, percent: int) -> DataFrame:
    """(tree, rank, place, node, n, home): members of all trees. ``rank`` is the token's place in the member's set, ``place``
    that among its shared tokens; ``home`` says that the tree's upper band is the member's."""
    each = firsts.select("node", "n", "alone", F.posexplode("prefix").alias("place", "token"))
    # a little wider than the ratio of sizes that can link, so that rounding never parts neighbours
    step = max(math.log(100 / percent) * (1 + 1e-6), 1e-6)
    band = F.floor(F.log(F.col("n").cast("double")) / step)
    both = F.explode(F.array(*[
        F.struct(F.xxhash64("token", band + k).alias("tree"), F.lit(not k).alias("home")) for k in (0, 1)
    ])).alias("b")
    rank = (F.col("alone") + F.col("place")).alias("rank")
    return durable(each.select(both, rank, "place", "node", "n").select("b.tree", "rank", "place", "node", "n", "b.home"))


def _planted(members: DataFrame, percent: int) -> DataFrame:
    """(tree, i, j, side, ...): one row per member and task, for the trees that can hold a link between components.

    ``members`` are (tree, rank, place, node, n, home, comp). What lies before the first token that two sets share is missing from the
    other one, so their ranks may not exceed together what the sizes allow to differ. A member whose rank is too large even
    for the tree's best partner is left out.
    """
    # whole numbers: rank of both <= (100 - percent) / (100 + percent) * size of both
    spare = (100 + percent) * F.col("rank") - (100 - percent) * F.col("n")
    members = members.withColumn("spare", spare.cast("long"))
    best = members.groupBy("tree").agg(F.min("spare").alias("best"), F.max("home").alias("home"), F.count("*").alias("texts"))
    best = durable(best.where("best <= 0 and home and texts > 1").select("tree", "best"))
    members = durable(members.join(_small(best), "tree").where(F.col("spare") + F.col("best") <= 0).drop("spare", "best"))
    trees = members.groupBy("tree").agg(
        F.count("*").alias("texts"), F.sum("n").alias("tokens"), F.sum("rank").alias("ranks"),
        # trees with the same members are told by two sums over these
        F.bit_xor(F.xxhash64("node")).alias("d1"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("d2"),
        F.min("comp").alias("least"), F.max("comp").alias("most"),
    ).where("texts > 1 and least != most")
    blocks = F.greatest(F.ceil(F.col("texts") / TREE_TEXTS), F.ceil(F.col("tokens") / TREE_TOKENS)).cast("int")
    # of equal trees the one whose token comes first, as that is where its members meet
    grown = trees.groupBy("texts", "d1", "d2").agg(F.min_by(F.struct("tree", blocks.alias("blocks")), "ranks").alias("t"))
    grown = durable(grown.select("t.tree", "t.blocks"))
    met = members.join(_small(grown), "tree")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    met = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return durable(
        met.select(
            "tree", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "comp",
            (F.col("own") > F.col("other")).cast("int").alias("side"), "n", "home", "place",
        )
    )


TREE = ("tree", "i", "j")


def _in_trees(rows: DataFrame) -> DataFrame:
    return rows.repartition(*TREE).sortWithinPartitions(*TREE)


def _links(planted: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """(a, b): links that join components, from trees planted with (tree, i, j, node, comp, side)."""
    nodes = planted.select("node").distinct()
    wanted = durable(classes.join(_small(nodes), "node").select("node", "rep.doc_id", "rep.text_key"))
    texts = docs.join(_small(wanted), list(ROW)).select("node", "text")
    sets = texts.mapInArrow(_tokens(width), "node long, tokens binary")
    rows = sets.join(_small(planted), "node").select(*TREE, "node", "comp", "side", "tokens")
    schema = "a long, b long"
    return durable(_in_trees(rows).mapInArrow(_by_tree(len(TREE), _grown(percent), schema), schema))


def linked(docs: DataFrame, percent: int = 80, width: int = WIDTH, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs`` (doc_id, text).

    Two texts are linked if they share at least ``percent`` per cent of the union of their shingles, runs of ``width``
    words; ``component_id`` is the smallest doc_id reachable over links. A text of fewer words has the whole sequence as its only
    shingle. Texts without words (null, empty, blank) have no shingles and stand alone. A row without doc_id is linked with
    nothing and has no component_id. Rows that repeat a doc_id are texts of their own. Columns named in
    ``carry`` come along, others are not read; an empty table gives no rows.
    """
    key = (F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(*OWN).alias("text_key"))
    carried = docs.select(*OWN, F.xxhash64(*OWN).alias("text_key"), *carry)
    texts = docs.select(*key, "text")
    schema = ", ".join([SET_SCHEMA, fields(carried, ("text_key", *carry))])
    sketches = durable(carried.mapInArrow(_sets(width), schema))
    usable = F.col("digest").isNotNull() & F.col("doc_id").isNotNull()
    # the number is that of the row in the written table, and so the same in all later steps
    classes = durable(
        sketches.where(usable).groupBy("digest")
        .agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.min("n_shingles").alias("n"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    firsts = _firsts(classes, texts, percent, width)
    members = _forest(firsts, percent)
    links = found = None
    for begun, some in ((0, members.where(F.col("place") < FIRST)), (FIRST, members)):
        placed = some.withColumn("comp", F.col("node"))
        if found is not None:
            placed = some.join(_small(found), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        rows = firsts.select("node", "alone", "last_texts", "prefix").join(_small(_planted(placed, percent)), "node")
        rows = _in_trees(rows.select(*TREE, "node", "comp", "side", "n", "home", "place", "alone", "last_texts", "prefix"))
        schema = "tree long, i long, j long, node long, comp long, side long"
        new = durable(rows.mapInArrow(_by_tree(len(TREE), _new_pairs(percent, begun), schema), schema))
        fresh = _links(new, classes, texts, percent, width)
        links = fresh if links is None else links.unionByName(fresh)
        found = durable(components(links))
    grouped = classes.select("digest", "node", "rep").join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = grouped.groupBy("comp").agg(F.min("rep.doc_id").alias("component_id"))
    named = grouped.join(least, "comp").select("digest", "component_id")
    slim = sketches.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"), *carry)
    out = ["doc_id", "n_shingles", "component_id", *carry]
    alone = slim.where(F.col("digest").isNull()).withColumn("component_id", F.col("doc_id"))
    return slim.where(F.col("digest").isNotNull()).join(named, "digest").select(*out).unionByName(alone.select(*out))
