"""Near-duplicate texts by SetSketch registers, bands, a likelihood test and an exact check.

Each text is the set of its distinct shingles. Texts with the same set form a class, of which one member
goes on. A class gets ``REGISTERS`` registers: the smallest of exponentially distributed values of its
shingles, on a logarithmic scale and truncated (Ertl, SetSketch, 2021). Registers of a union are the
smaller values of both, so sketches can be merged. Classes that agree on a whole band of registers meet in a bucket.

A bucket is never turned into all its pairs. First each member meets the bucket's smallest member; pairs whose
registers rule out the wanted similarity by a likelihood test are left out, the others are confirmed on
the full sets. Then, in buckets whose members still lie in different components, every member outside the
bucket's largest component meets all members of other components: in small buckets as pairs, in large ones in tiles
that are compared by matrix products. After that no pair of one bucket that can be a link and lies in different
components is untested. Two texts at the threshold miss each other in all buckets with a probability of (1 - 0.8**6)**40 = 5e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm import words
from reviewloom.llm.graph import components
from reviewloom.llm.scope import fields
from reviewloom.session import durable

WIDTH = 5  # words of a shingle, unless stated otherwise
BAND_ROWS, BANDS = 6, 40
REGISTERS = BAND_ROWS * BANDS
SCALE_BASE, RATE, TOP = 1.001, 20.0, 65_534  # b, a and q of the sketch; registers run from 0 to q + 1
EVIDENCE = 14.0  # log-likelihood by which the threshold must lose before a pair is ruled out
MEMBERS_PER_TASK_GROUP = 2_000  # texts that meet one centre in one group of the exact check
DIRECT_MEMBERS = 64  # of a bucket whose members can all meet as pairs; larger ones meet in tiles
TILE_SHINGLES, TILE_TEXTS = 200_000, 2_000  # of one side of a tile, on average, whichever is reached first
TILE_COLUMNS, SCORES = 4_096, 4_000_000  # shingles of a product, and pairs of a tile held at a time
BROADCAST_IDS = 1_000_000  # ids of texts to fetch (16 bytes each) up to which the list is broadcast

_odd = np.random.default_rng(20210)
MULTIPLIERS = (_odd.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1)).astype(np.uint32)
OFFSETS = _odd.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
BAND_FACTORS = (_odd.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) | np.uint64(1)).reshape(BANDS, BAND_ROWS)

SKETCH_SCHEMA = "doc_id long, n_shingles long, digest binary, registers binary"
OWN = ("doc_id", "text")
ROW = "struct<doc_id: long, text_key: long>"  # by which a text is fetched; several texts can share a doc_id


def registers_of(found: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(sets, REGISTERS) registers as 16-bit numbers; sets must not be empty."""
    low = (found >> np.uint64(16)).astype(np.uint32)
    least = np.empty((REGISTERS, len(bounds) - 1), dtype=np.uint32)
    held = np.empty_like(low)
    for i in range(REGISTERS):
        np.multiply(low, MULTIPLIERS[i], out=held)
        np.add(held, OFFSETS[i], out=held)
        np.minimum.reduceat(held, bounds[:-1], out=least[i])
    smallest = -np.log1p(-(least.T.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(smallest) / np.log(SCALE_BASE)), 0, TOP + 1).astype(np.uint16)


def digests_of(found: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """16 bytes per set that do not depend on the order of its members; sets must not be empty."""
    one = np.add.reduceat(words.mix(found ^ words.LEFT), bounds[:-1])
    two = np.add.reduceat(words.mix(found ^ words.RIGHT), bounds[:-1])
    return np.stack([words.mix(one), words.mix(two)], axis=1)


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    rows = np.ascontiguousarray(rows)
    width = rows.dtype.itemsize * rows.shape[1] if rows.size else 1
    return pa.FixedSizeBinaryArray.from_buffers(
        pa.binary(width), len(rows), [None, pa.py_buffer(rows.tobytes())]
    ).cast(pa.binary())


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch):
                found, bounds = words.shingles(part.column("text"), width)
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                empty = pa.array(sizes == 0)
                if len(full):
                    tight = np.append(bounds[:-1][full], bounds[-1])
                    place = pa.array(np.where(sizes > 0, np.cumsum(sizes > 0) - 1, 0))
                    digest = _fixed(digests_of(found, tight)).take(place)
                    registers = _fixed(registers_of(found, tight)).take(place)
                    none = pa.scalar(None, pa.binary())
                    digest = pa.compute.if_else(empty, none, digest)
                    registers = pa.compute.if_else(empty, none, registers)
                else:
                    digest = registers = pa.nulls(part.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()), pa.array(sizes.astype(np.int64)), digest, registers,
                        *(part.column(c) for c in part.schema.names if c not in OWN),
                    ],
                    names=["doc_id", "n_shingles", "digest", "registers", *(c for c in part.schema.names if c not in OWN)],
                )

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), REGISTERS)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 2_000):
            part = batch.slice(start, 2_000)
            values = _matrix(part.column("registers")).astype(np.uint64).reshape(-1, BANDS, BAND_ROWS)
            keys = words.mix((words.mix(values + words.LEFT) * BAND_FACTORS).sum(axis=2, dtype=np.uint64))
            keys ^= words.mix(np.arange(BANDS, dtype=np.uint64) * words.RIGHT + words.ALONE)
            rows = pa.array(np.repeat(np.arange(part.num_rows), BANDS))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.reshape(-1).view(np.int64)), part.column("digest").take(rows)],
                names=["bucket", "node"],
            )


def _order_shares(similarity: np.ndarray, u: np.ndarray, v: np.ndarray):
    """Probabilities that a register of the one set is larger, smaller, or equal to that of the other."""

    def share(x):
        return -np.log1p(-x * (SCALE_BASE - 1) / SCALE_BASE) / np.log(SCALE_BASE)

    more, less = share(np.clip(u - v * similarity, 0, 1)), share(np.clip(v - u * similarity, 0, 1))
    return more, less, 1 - more - less


def log_likelihood(similarity, u, v, more, less, equal):
    """Of a similarity, given on how many registers the one set is larger, smaller, equal."""
    p, q, r = (np.clip(x, 1e-12, 1) for x in _order_shares(similarity, u, v))
    return more * np.log(p) + less * np.log(q) + equal * np.log(r)


def may_reach(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether registers leave room for the similarity, given both sizes.

    The similarity is estimated jointly by maximum likelihood; a pair is ruled out if the estimate lies below the
    threshold and the threshold is less likely by EVIDENCE.
    """
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - more - less
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    most = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    wanted = percent / 100
    grid = np.linspace(0, 1, 101)[None, :] * most[:, None]
    each = log_likelihood(
        grid, u[:, None], v[:, None], more[:, None], less[:, None], equal[:, None]
    )
    best = np.take_along_axis(grid, each.argmax(axis=1)[:, None], axis=1)[:, 0]
    at_threshold = log_likelihood(np.minimum(wanted, most), u, v, more, less, equal)
    possible = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    return possible & ((best >= wanted) | (each.max(axis=1) - at_threshold <= EVIDENCE))


def _plausible(percent: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2_000):
                part = batch.slice(start, 2_000)
                fits = may_reach(
                    _matrix(part.column("registers_a")), _matrix(part.column("registers_b")),
                    part.column("n_a").to_numpy(), part.column("n_b").to_numpy(), percent,
                )
                yield part.select(["a", "b", "rep_a", "rep_b"]).filter(pa.array(fits))

    return keep


def _confirm(percent: int, width: int):
    """Rows sorted by centre, the centre's own text first: the pairs whose full sets are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, centre = None, None
        for batch in batches:
            for part in words.chunks(batch):
                found, bounds = words.shingles(part.column("text"), width)
                groups = list(zip(part.column("a").to_pylist(), part.column("salt").to_pylist(), strict=True))
                nodes, first = part.column("b").to_pylist(), part.column("is_centre").to_pylist()
                out_a, out_b = [], []
                for i, key in enumerate(groups):
                    own = found[bounds[i] : bounds[i + 1]]
                    if first[i]:
                        group, centre = key, own
                    elif key == group:
                        both = len(np.intersect1d(own, centre, assume_unique=True))
                        if 100 * both >= percent * (len(own) + len(centre) - both):
                            out_a.append(key[0])
                            out_b.append(nodes[i])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())], names=["a", "b"]
                )

    return check


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """The (a, b) of ``pairs`` (a, b, rep_a, rep_b) whose texts are similar enough on their full shingle sets.

    Texts travel to the centre ``a``; a centre with many members is met by them in several salted groups.
    """
    needed = durable(
        pairs.select(F.col("rep_a").alias("row")).unionByName(pairs.select(F.col("rep_b").alias("row"))).distinct()
    )
    ids = F.broadcast(needed) if needed.count() <= BROADCAST_IDS else needed
    texts = docs.join(ids, "row", "left_semi")
    degrees = pairs.groupBy("a").agg(F.count("*").alias("degree"))
    groups = F.ceil(F.col("degree") / MEMBERS_PER_TASK_GROUP).cast("int")
    salted = pairs.join(degrees, "a").withColumn(
        "salt", F.pmod(F.xxhash64("b"), F.greatest(groups, F.lit(1))).cast("int")
    )
    salted = durable(salted.select("a", "b", "salt", "rep_a", "rep_b"))
    centres = salted.select("a", "salt", F.col("rep_a").alias("row")).distinct()
    members = salted.select("a", "salt", "b", F.col("rep_b").alias("row"))
    rows = centres.select("a", "salt", F.col("a").alias("b"), F.lit(True).alias("is_centre"), "row").unionByName(
        members.select("a", "salt", "b", F.lit(False).alias("is_centre"), "row")
    )
    near = rows.join(texts, "row").select("a", "salt", "b", "is_centre", "text")
    near = near.repartition("a", "salt").sortWithinPartitions("a", "salt", F.desc("is_centre"))
    return near.mapInArrow(_confirm(percent, width), "a binary, b binary")


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that sizes and registers do not rule out, with the texts that stand for them."""
    for side in "ab":
        own = classes.select(
            F.col("node").alias(side), F.col("rep").alias(f"rep_{side}"),
            F.col("n").alias(f"n_{side}"), F.col("registers").alias(f"registers_{side}"),
        )
        pairs = pairs.join(own, side)
        if side == "b":
            pairs = pairs.where(
                100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
            )
    return durable(pairs.mapInArrow(_plausible(percent), f"a binary, b binary, rep_a {ROW}, rep_b {ROW}"))


def _placed(members: DataFrame, found: DataFrame) -> DataFrame:
    """(bucket, node, comp): members of buckets with the component they are known to be in."""
    return durable(
        members.select("bucket", "node").join(found, "node", "left")
        .select("bucket", "node", F.coalesce("comp", "node").alias("comp"))
    )


def _mixed(placed: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components: with the largest one, one member of that, and the bucket's size."""
    per_component = placed.groupBy("bucket", "comp").agg(F.count("*").alias("size"), F.min("node").alias("one"))
    mixed = durable(
        per_component.groupBy("bucket")
        .agg(
            F.count("*").alias("components"), F.sum("size").alias("members"),
            F.max(F.struct("size", "comp", "one")).alias("largest"),
        )
        .where("components > 1")
        .select("bucket", "members", F.col("largest.comp").alias("largest"), F.col("largest.one").alias("one"))
    )
    return placed.join(mixed, "bucket")


def _across(mixed: DataFrame) -> DataFrame:
    """All pairs of a bucket that lie in different components; one of the two is always outside the largest one."""
    rest = mixed.where("comp != largest").select("bucket", F.col("node").alias("a"), F.col("comp").alias("comp_a"))
    other = F.col("comp") != F.col("comp_a")
    once = (F.col("comp") == F.col("largest")) | (F.col("a") < F.col("node"))
    return rest.join(mixed, "bucket").where(other & once).select("a", F.col("node").alias("b")).distinct()


def _tile(percent: int, width: int = WIDTH):
    """Links between the two sides of a tile, one for each component that a node of the left side reaches."""

    def run(tile: pa.Table) -> pa.Table:
        tile = tile.combine_chunks().sort_by("node")
        found, bounds = words.shingles(tile["text"].combine_chunks(), width)
        nodes, comps = tile["node"].to_pylist(), tile["comp"].to_pylist()
        size = np.diff(bounds)
        _, column = np.unique(found, return_inverse=True)
        owner = np.repeat(np.arange(len(nodes)), size)
        left = np.flatnonzero(tile["is_rest"].to_numpy())
        right = np.flatnonzero(~tile["is_rest"].to_numpy())
        place = np.zeros(len(nodes), dtype=np.int64)
        place[right] = np.arange(len(right))
        is_left = np.zeros(len(nodes), dtype=bool)
        is_left[left] = True
        out = {}
        step = max(1, SCORES // max(1, len(right)))
        for start in range(0, len(left), step):
            strip = left[start : start + step]
            inside = np.zeros(len(nodes), dtype=bool)
            inside[strip] = True
            place[strip] = np.arange(len(strip))
            both = np.zeros((len(strip), len(right)), dtype=np.float32)
            # shared shingles of all pairs, by products of incidence matrices over ranges of shingles
            for at in range(0, int(column.max(initial=-1)) + 1, TILE_COLUMNS):
                here = np.flatnonzero((column >= at) & (column < at + TILE_COLUMNS))
                sides = []
                for side, count in ((inside, len(strip)), (~is_left, len(right))):
                    own = here[side[owner[here]]]
                    matrix = np.zeros((count, TILE_COLUMNS), dtype=np.float32)
                    matrix[place[owner[own]], column[own] - at] = 1.0
                    sides.append(matrix)
                both += sides[0] @ sides[1].T
            either = size[strip][:, None] + size[right][None, :] - both
            for i, j in zip(*np.nonzero((100 * both >= percent * either) & (either > 0)), strict=True):
                a, b = strip[i], right[j]
                if comps[a] != comps[b]:
                    out.setdefault((nodes[a], comps[b]), nodes[b])
        return pa.table({
            "a": pa.array([a for a, _ in out], pa.binary()), "b": pa.array(list(out.values()), pa.binary()),
        })

    return run


def _in_tiles(large: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, width: int = WIDTH) -> DataFrame:
    """Links (a, b) between components among the members of large buckets (node, comp, one).

    Buckets that share members make a cluster. What lies outside a cluster's largest component meets the whole cluster,
    in tiles bounded in shingles and texts, where all shared shingles are counted by a matrix product; pairs never leave a task.
    """
    clusters = components(large.select(F.col("node").alias("a"), F.col("one").alias("b")))
    nodes = durable(
        large.select("node", "comp").distinct().join(clusters.withColumnRenamed("comp", "cluster"), "node")
        .join(classes.select("node", "rep", "n"), "node")
    )
    largest = nodes.groupBy("cluster", "comp").agg(F.count("*").alias("size"))
    largest = largest.groupBy("cluster").agg(F.max(F.struct("size", "comp")).alias("largest"))
    nodes = durable(
        nodes.join(largest, "cluster").withColumn("outside", F.col("comp") != F.col("largest.comp")).drop("largest")
    )

    def blocks(side):
        by_size = F.ceil(F.sum(side) / TILE_SHINGLES)
        return F.greatest(by_size, F.ceil(F.count(side) / TILE_TEXTS), F.lit(1)).cast("int")

    plan = durable(
        nodes.groupBy("cluster").agg(
            blocks(F.col("n")).alias("blocks"), blocks(F.when(F.col("outside"), F.col("n"))).alias("rest_blocks"),
            F.max("outside").alias("mixed"),
        ).where("mixed")
    )
    nodes = nodes.join(plan, "cluster")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rest_block = F.pmod(F.xxhash64("node"), F.col("rest_blocks")).cast("int")

    def every(count):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    kept = ["cluster", "node", "comp", F.col("rep").alias("row")]
    rows = nodes.where("outside").select(
        *kept, F.lit(True).alias("is_rest"), rest_block.alias("i"), every("blocks").alias("j")
    ).unionByName(nodes.select(*kept, F.lit(False).alias("is_rest"), every("rest_blocks").alias("i"), block.alias("j")))
    rows = durable(rows)
    ids = rows.select("row").distinct()
    texts = docs.join(F.broadcast(ids) if rows.count() <= BROADCAST_IDS else ids, "row", "left_semi")
    tiles = rows.join(texts, "row").select("cluster", "i", "j", "node", "comp", "is_rest", "text")
    stated = () if width == WIDTH else (width,)
    return tiles.groupBy("cluster", "i", "j").applyInArrow(_tile(percent, *stated), "a binary, b binary")


def near_duplicates(
    docs: DataFrame, percent: int = 80, carry: tuple[str, ...] = (), width: int = WIDTH
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs`` (doc_id, text).

    Two texts are linked if they share at least ``percent`` per cent of the union of their shingles, runs of ``width`` words.
    ``component_id`` is the smallest doc_id reachable over links, and ``kept`` marks that row. Texts without words
    (null, empty, blank) have no shingles and stand alone. A row without doc_id is linked with nothing, has no
    component_id and is kept. Rows that repeat a doc_id are texts of their own; all rows whose doc_id is
    the smallest of their component are kept. Columns named in ``carry`` come along, others are not read.
    """
    row = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(*OWN).alias("text_key")).alias("row")
    carried = docs.select(*OWN, row, *carry)
    docs = docs.select(row, "text")
    sketches = durable(carried.mapInArrow(_sketch(width), ", ".join([SKETCH_SCHEMA, fields(carried, ("row", *carry))])))
    usable = F.col("digest").isNotNull() & F.col("doc_id").isNotNull()
    classes = durable(
        sketches.where(usable)
        .groupBy(F.col("digest").alias("node"))
        .agg(F.min("row").alias("rep"), F.min("n_shingles").alias("n"), F.first("registers").alias("registers"))
    )
    buckets = classes.select(F.col("node").alias("digest"), "registers").mapInArrow(_bands, "bucket long, node binary")
    several = (
        buckets.groupBy("bucket")
        .agg(F.count("*").alias("members"), F.min("node").alias("centre"))
        .where("members > 1")
        .select("bucket", "centre")
    )
    members = durable(buckets.join(several, "bucket").select("bucket", "centre", "node"))
    # first: every member against the smallest one of its bucket
    first = members.where("node != centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    first = _likely(first, classes, percent)
    links = durable(confirmed(first, docs, percent, width))
    found = durable(components(links))
    # then, in buckets that hold several components, what lies outside the largest one against all others
    mixed = durable(_mixed(_placed(members, found)))
    second = _across(mixed.where(F.col("members") <= DIRECT_MEMBERS).drop("members"))
    second = second.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # the first pairs have the smaller node first, too
    second = _likely(second.join(first.select("a", "b"), ["a", "b"], "left_anti"), classes, percent)
    tiled = _in_tiles(mixed.where(F.col("members") > DIRECT_MEMBERS), classes, docs, percent, width)
    found = durable(components(links.unionByName(confirmed(second, docs, percent, width)).unionByName(tiled)))
    grouped = classes.select("node", "rep").join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = grouped.groupBy("comp").agg(F.min("rep.doc_id").alias("least"))
    named = grouped.join(least, "comp").select(F.col("node").alias("digest"), F.col("least"))
    slim = sketches.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"), *carry)
    linked = slim.where(F.col("digest").isNotNull()).join(named, "digest")
    alone = slim.where(F.col("digest").isNull()).withColumn("least", F.col("doc_id"))
    return (
        linked.select("doc_id", "n_shingles", "least", *carry)
        .unionByName(alone.select("doc_id", "n_shingles", "least", *carry))
        .select(
            "doc_id", "n_shingles", F.col("least").alias("component_id"),
            F.coalesce(F.col("doc_id") == F.col("least"), F.lit(True)).alias("kept"),
            *carry,
        )
    )
