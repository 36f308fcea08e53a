"""Top-k items for every user out of all items, without storing one row per pair.

Users and items are hashed into blocks. One task holds one user block with its lists, lets the items of one
item block stream past in order of their ids, some thousands at a time, scores them with a matrix product and
hands on the k best items per user with their ranks. Only users need blocks for memory, so a list leaves few
cells; if it leaves one only, it is whole and not shuffled, else the lists of a user's blocks are merged by rank.
A later item with an equal score comes after an earlier one, so a user whose list holds highest possible scores
only is done. Nothing is broadcast. Items a user has already rated are sent to the one cell they belong to, as pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from reviewloom.operators.cells import by_cell
from reviewloom.session import durable

Scorer = Callable[[np.ndarray, np.ndarray], np.ndarray]


class DotScorer:
    """Inner products plus a constant, kept within the rating scale if one is given."""

    def __init__(self, offset: float = 0.0, clip: tuple[float, float] | None = None):
        self.offset, self.clip = offset, clip

    def _finished(self, out: np.ndarray) -> np.ndarray:
        if self.offset:
            out += self.offset
        return np.clip(out, *self.clip, out=out) if self.clip else out

    def __call__(self, users: np.ndarray, items: np.ndarray) -> np.ndarray:
        """All scores, as a matrix."""
        return self._finished(users @ items.T)

    def of_pairs(self, users: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Scores of pairs of rows."""
        return self._finished(np.einsum("ij,ij->i", users, items))


BLOCK_ROWS = 32_768  # items scored at a time: 16 MB per 64 doubles
FIRST_ITEMS, FIRST_PER_PLACE = 1_024, 32  # items scored at first, twice as many each time: they set the scores that later ones have to beat
FIRST_TO_FILL = 16  # items per place scored at first where lists can be full of highest possible scores, which ends them
BLOCK_BYTES = 192 << 20  # of users and their lists in one cell
VECTOR_BYTES, LISTED_BYTES, HELD_BYTES = 512, 24, 12  # what a row of either side, a listed item and one held by a task weigh, roughly
ROWS_OUT = 100_000
TILE = 4_000_000  # scores held at a time inside a cell
NEAR_USERS, NEAR_ITEMS = 512, 512  # sides of a tile of single precision, which stays in a core's cache
SINGLE = 2.0**-24  # relative error of one operation in single precision
MOST_LENGTH = 1e15  # of a vector that single precision is used for


def round_half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Round halves away from zero, as SQL does."""
    scale = 10.0**digits
    return np.copysign(np.floor(np.abs(x) * scale + 0.5), x) / scale + 0.0


def best_per_row(scores: np.ndarray, order: np.ndarray, k: int, digits: int):
    """(row, column, score) of the k best columns of each row; ties go to the lower ``order``.

    Scores are compared after rounding, so every column that could round up to the k-th score is
    looked at before the cut.
    """
    width = scores.shape[1]
    if width > k:
        kth = np.partition(scores, width - k, axis=1)[:, width - k]
        rows, cols = np.nonzero(scores >= (kth - 10.0**-digits)[:, None])
    else:
        rows, cols = np.nonzero(np.ones(scores.shape, dtype=bool))
    values = scores[rows, cols]
    alive = values > -np.inf
    rows, cols, values = rows[alive], cols[alive], round_half_up(values[alive], digits)
    sort = np.lexsort((order[cols], -values, rows))
    rows, cols, values = rows[sort], cols[sort], values[sort]
    starts = np.searchsorted(rows, np.arange(scores.shape[0]))
    keep = np.arange(len(rows)) - starts[rows] < k
    return rows[keep], cols[keep], values[keep]


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def id_ranks(ids: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """Ids as one array, and the place of each in ascending order."""
    ids = ids.combine_chunks()
    place = np.empty(len(ids), dtype=np.int64)
    place[pa.compute.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    return ids, place


class _Best:
    """The k best items so far of each of some users, best first; items are places in one ascending stream of ids."""

    def __init__(self, users: int, k: int, digits: int):
        self.k, self.digits = k, digits
        self.score = np.full((users, k), -np.inf)
        self.item = np.full((users, k), -1, dtype=np.int32)

    def open(self, ceiling: float) -> np.ndarray:
        """Users whose list can still change: an equal score of a later item is no better, so lists full of highest scores cannot."""
        return np.flatnonzero(self.score[:, -1] < ceiling)

    def add(self, at: np.ndarray, scores: np.ndarray, first: int) -> None:
        """``scores`` of the users ``at`` for the items from ``first`` on."""
        kth = self.score[at, -1]
        if np.isneginf(kth).any():
            rows, cols, values = best_per_row(scores, np.arange(scores.shape[1]), self.k, self.digits)
        else:
            # only what rounds to more than the k-th score counts
            rows, cols = np.nonzero(scores > (kth + 0.25 * 10.0**-self.digits)[:, None])
            values = round_half_up(scores[rows, cols], self.digits)
        self.take(at, rows, cols, values, first)

    def take(self, at: np.ndarray, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, first: int) -> None:
        """Rounded scores of pairs of users and items, in order of these for each user."""
        new = values > self.score[at[rows], -1]
        rows, cols, values = rows[new], cols[new], values[new]
        if not len(rows):
            return
        changed = np.unique(rows)
        old = np.repeat(changed, self.k)
        row = np.concatenate([old, rows])
        value = np.concatenate([self.score[at[changed]].reshape(-1), values])
        item = np.concatenate([self.item[at[changed]].reshape(-1), (first + cols).astype(np.int32)])
        sort = np.lexsort((-value, row))  # stable: of equal scores those of earlier items come first
        row, value, item = row[sort], value[sort], item[sort]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        self.score[at[row[keep]], place[keep]] = value[keep]
        self.item[at[row[keep]], place[keep]] = item[keep]


class _Near:
    """Pairs of a step whose inner product in single precision leaves open whether they beat a score.

    The error of a product is bounded by its length and by the lengths of both vectors, so no pair that beats the score is
    missed; the few that are found are scored again in double precision.
    """

    def __init__(self, users: np.ndarray):
        self.size = np.linalg.norm(users, axis=1) if len(users) else np.zeros(0)
        self.usable = bool((self.size < MOST_LENGTH).all())
        self.users = users.astype(np.float32) if self.usable else None
        self.items: np.ndarray | None = None

    def step(self, vecs: np.ndarray) -> bool:
        """Take the items of the next step; tells whether their lengths allow for single precision."""
        largest = np.linalg.norm(vecs, axis=1).max() if len(vecs) else 0.0
        if not (self.usable and largest < MOST_LENGTH):
            return False
        self.items = vecs.astype(np.float32)
        self.error = (vecs.shape[1] + 8) * SINGLE * largest
        return True

    def above(self, at: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) of the pairs of the users ``at`` that may be above their ``least``, in order of both."""
        n = len(self.items)
        bound = least - self.error * self.size[at] - 4 * SINGLE * np.abs(least)
        bound = np.nextafter(bound.astype(np.float32), np.float32(-np.inf))[:, None]
        users, hits = self.users[at], []
        for a in range(0, n, NEAR_ITEMS):
            items = self.items[a : a + NEAR_ITEMS]
            width = -len(items) % 8 + len(items)  # eight marks are looked at at once
            marks = np.zeros((len(at), width), dtype=bool)
            np.greater(users @ items.T, bound, out=marks[:, : len(items)])
            eights = np.flatnonzero(marks.view(np.uint64))
            if len(eights):
                which, place = np.nonzero(marks.reshape(-1, 8)[eights])
                flat = eights[which] * 8 + place
                hits.append(flat // width * n + (a + flat % width))
        found = np.sort(np.concatenate(hits)) if hits else np.empty(0, dtype=np.int64)
        return found // n, found % n


def _in_steps(batches: Iterator[pa.RecordBatch], fewest: int, most: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and vectors of items, a few at first and then up to ``most`` at a time."""
    wanted, ids, vecs, held = fewest, [], [], 0
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            part = batch.slice(start, wanted - held)
            start += part.num_rows
            ids.append(part.column("item_id"))
            vecs.append(matrix(part.column("vec")))
            held += part.num_rows
            if held == wanted:
                yield pa.concat_arrays(ids), np.concatenate(vecs)
                wanted, ids, vecs, held = min(2 * wanted, most), [], [], 0
    if held:
        yield pa.concat_arrays(ids), np.concatenate(vecs)


USER, PAIR, ITEM = 0, 1, 2  # kinds of rows of a cell, in the order in which they come


def _cell(scorer: Scorer, k: int, digits: int, ceiling: float, mark: bool):
    """The k best items of the cell's users. Pairs are left out before the cut or, if ``mark``, marked after it."""

    def top_of_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user_parts, vec_parts, pair_users, pair_items = [], [], [], []

        def items_of() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kind = batch.column("kind").to_numpy()
                users, pairs, items = (batch.filter(pa.array(kind == which)) for which in (USER, PAIR, ITEM))
                user_parts.append(users.column("user_id"))
                if users.num_rows:
                    vec_parts.append(matrix(users.column("vec")))
                pair_users.append(pairs.column("user_id"))
                pair_items.append(pairs.column("item_id"))
                if items.num_rows:
                    yield items

        best, n_items, item_ids = None, 0, []
        fewest = max(FIRST_ITEMS, FIRST_PER_PLACE * k) if math.isinf(ceiling) else FIRST_TO_FILL * k
        for ids, vecs in _in_steps(items_of(), fewest, BLOCK_ROWS):
            if best is None:  # all users and pairs come before the first item
                user_ids = pa.concat_arrays(user_parts)
                if not len(user_ids):
                    return
                user_vecs = np.concatenate(vec_parts)
                vec_parts.clear()
                best = _Best(len(user_ids), k, digits)
                near = _Near(user_vecs) if isinstance(scorer, DotScorer) else None
                seen_u, seen_items = pa.compute.index_in(pa.concat_arrays(pair_users), user_ids), pa.concat_arrays(pair_items)
                known = pa.compute.is_valid(seen_u)
                seen_u, seen_items = seen_u.filter(known).to_numpy(), seen_items.filter(known)
                user_parts.clear(), pair_users.clear(), pair_items.clear()
            users = best.open(ceiling)
            left_u = left_i = np.empty(0, dtype=np.int64)
            if not mark and len(seen_items) and len(users):
                found = pa.compute.index_in(seen_items, ids)
                here = np.flatnonzero(pa.compute.is_valid(found).to_numpy(zero_copy_only=False))
                here = here[np.argsort(seen_u[here], kind="stable")]
                left_u, left_i = seen_u[here], found.take(pa.array(here)).to_numpy()
            if near is not None and near.step(vecs):
                full = users[best.score[users, -1] > -np.inf]
                for start in range(0, len(full), NEAR_USERS):
                    at = full[start : start + NEAR_USERS]
                    rows, cols = near.above(at, best.score[at, -1] + (0.25 * 10.0**-digits - scorer.offset))
                    if len(left_u) and len(rows):
                        a, b = np.searchsorted(left_u, [at[0], at[-1] + 1])
                        unseen = ~np.isin(at[rows] * len(ids) + cols, left_u[a:b] * len(ids) + left_i[a:b])
                        rows, cols = rows[unseen], cols[unseen]
                    for part in range(0, len(rows), BLOCK_ROWS):
                        r, c = rows[part : part + BLOCK_ROWS], cols[part : part + BLOCK_ROWS]
                        best.take(at, r, c, round_half_up(scorer.of_pairs(user_vecs[at[r]], vecs[c]), digits), n_items)
                users = users[best.score[users, -1] == -np.inf] if len(full) else users
            step = max(1, TILE // len(ids))
            for start in range(0, len(users), step):
                at = users[start : start + step]
                scores = scorer(user_vecs[at], vecs)
                a, b = np.searchsorted(left_u, [at[0], at[-1] + 1])
                row = np.searchsorted(at, left_u[a:b])
                own = at[row] == left_u[a:b]  # users with a full list are not in the tile
                scores[row[own], left_i[a:b][own]] = -np.inf
                best.add(at, scores, n_items)
            n_items += len(ids)
            item_ids.append(ids)
        if best is None:
            return
        all_ids = pa.concat_arrays(item_ids)
        marked = _pairs_of(best, all_ids, seen_u, seen_items) if mark else None
        ranks = _ranks(best, user_ids, all_ids)
        for start in range(0, len(user_ids), rows_out := max(1, ROWS_OUT // k)):
            part = slice(start, start + rows_out)
            rows, places = np.nonzero(ranks[part] >= 0)
            columns = [
                user_ids.take(pa.array(rows + start)), all_ids.take(pa.array(best.item[part][rows, places])),
                pa.array(best.score[part][rows, places]), pa.array(ranks[part][rows, places]),
            ]
            if mark:
                columns.append(pa.array(marked[part][rows, places]))
            yield pa.RecordBatch.from_arrays(columns, names=["user_id", "item_id", "score", "item_rank", "marked"][: len(columns)])

    return top_of_cell


def _ranks(best: _Best, user_ids: pa.Array, ids: pa.Array) -> np.ndarray:
    """Rank of each entry of the lists as ``rank_items`` gives it, -1 for none: an item without id comes first among equal
    scores, and rows that share a user_id share a list."""
    ranks = np.where(best.item >= 0, np.arange(best.k, dtype=np.int32), np.int32(-1))
    codes = user_ids.dictionary_encode("encode")
    user = codes.indices.to_numpy()
    shared = np.bincount(user, minlength=len(codes.dictionary))[user] > 1
    if ids.null_count:
        nameless = np.flatnonzero(ids.is_null().to_numpy(zero_copy_only=False))
        shared |= np.isin(best.item, nameless).any(axis=1)
    rows = np.flatnonzero(shared)
    if len(rows):
        at, place = np.nonzero(best.item[rows] >= 0)
        at = rows[at]
        item = best.item[at, place].astype(np.int64)
        if ids.null_count:
            item[np.isin(item, nameless)] = -1
        sort = np.lexsort((item, -best.score[at, place], user[at]))
        at, place = at[sort], place[sort]
        rank = np.arange(len(at)) - np.searchsorted(user[at], user[at])
        ranks[at, place] = np.where(rank < best.k, rank, -1)
    return ranks


def _pairs_of(best: _Best, ids: pa.Array, pair_users: np.ndarray, pair_items: pa.Array) -> np.ndarray:
    """Which entries of the lists are among the given pairs; an id that comes twice counts as one."""
    codes = ids.dictionary_encode()
    pair_codes = pa.compute.index_in(pair_items, codes.dictionary)
    known = pa.compute.is_valid(pair_codes).to_numpy(zero_copy_only=False)
    width = len(codes.dictionary)
    pairs = pair_users[known].astype(np.int64) * width + pair_codes.drop_null().to_numpy()
    number = codes.indices.to_numpy(zero_copy_only=False)
    listed = np.arange(len(best.item), dtype=np.int64)[:, None] * width + number[np.maximum(best.item, 0)]
    return np.isin(listed, pairs)


def block_counts(n_users: int, n_items: int, tasks: int, k: int, block_bytes: int = BLOCK_BYTES) -> tuple[int, int]:
    """Blocks per side: users few enough for memory, enough cells for every task, and little copying.

    A cell holds its users and their lists; items stream through it, so they need no blocks for memory. Each user travels
    to every item block and brings back k items from it; each item travels to every user block. For a given
    number of cells the copies are fewest when both sides move as many bytes; lists from one item block are not moved at all.
    """
    least_users = math.ceil(n_users * (VECTOR_BYTES + k * HELD_BYTES) / block_bytes) or 1
    cells = max(tasks, least_users)
    balance = n_items * VECTOR_BYTES / max(1.0, n_users * (VECTOR_BYTES + k * LISTED_BYTES))
    item_blocks = max(1, min(round(math.sqrt(cells * balance)), n_items))
    user_blocks = max(least_users, min(math.ceil(cells / item_blocks), max(1, n_users)))
    shared = user_blocks * n_items * VECTOR_BYTES + item_blocks * n_users * (VECTOR_BYTES + k * LISTED_BYTES)
    if n_users >= cells and cells * n_items * VECTOR_BYTES + n_users * VECTOR_BYTES < shared:
        return cells, 1
    return user_blocks, item_blocks


def rank_items(scored: DataFrame, k: int, *more: str) -> DataFrame:
    """(user_id, item_rank, item_id, score): the k best, ranks from 0, ties to the lower item id; and the columns ``more``."""
    best_first = W.partitionBy("user_id").orderBy(F.desc("score"), "item_id")
    return (
        scored.withColumn("_place", F.row_number().over(best_first))
        .where(F.col("_place") <= k)
        .select("user_id", (F.col("_place") - 1).alias("item_rank"), "item_id", "score", *more)
    )


def grid_top_k(
    users: DataFrame,
    items: DataFrame,
    k: int,
    scorer: Scorer,
    seen: DataFrame | None = None,
    digits: int = 6,
    blocks: tuple[int, int] | None = None,
    ceiling: float = math.inf,
    marked: DataFrame | None = None,
) -> DataFrame:
    """The k best items of each user by ``scorer(user_vecs, item_vecs)``, a matrix of scores.

    ``users`` is (user_id, vec), ``items`` is (item_id, vec), ``seen`` the (user_id, item_id) pairs to
    leave out. With ``marked`` pairs instead, the lists hold them and a column ``marked`` tells which they are.
    No score is above ``ceiling``. Only the two row counts come to the driver, to size the blocks.
    """
    if seen is not None and marked is not None:
        raise ValueError("pairs are left out or marked, not both")
    spark = users.sparkSession
    if blocks is None:
        # written once, so that counting does not compute the vectors a second time
        users, items = durable(users.select("user_id", "vec")), durable(items.select("item_id", "vec"))
        blocks = block_counts(users.count(), items.count(), spark.sparkContext.defaultParallelism, k)
    user_blocks, item_blocks = blocks
    user_type, item_type = users.schema["user_id"].dataType, items.schema["item_id"].dataType
    no_user, no_item = F.lit(None).cast(user_type), F.lit(None).cast(item_type)
    no_vec = F.lit(None).cast("array<double>")
    user_block = F.pmod(F.xxhash64("user_id"), F.lit(user_blocks)).cast("int")
    item_block = F.pmod(F.xxhash64("item_id"), F.lit(item_blocks)).cast("int")
    cells = users.select(
        F.lit(USER).alias("kind"),
        user_block.alias("user_block"),
        F.explode(F.sequence(F.lit(0), F.lit(item_blocks - 1))).alias("item_block"),
        "user_id",
        no_item.alias("item_id"),
        F.col("vec").cast("array<double>").alias("vec"),
    ).unionByName(
        items.select(
            F.lit(ITEM).alias("kind"),
            F.explode(F.sequence(F.lit(0), F.lit(user_blocks - 1))).alias("user_block"),
            item_block.alias("item_block"),
            no_user.alias("user_id"),
            "item_id",
            F.col("vec").cast("array<double>").alias("vec"),
        )
    )
    given = seen if marked is None else marked.dropna(subset=["user_id", "item_id"])
    if given is not None:
        # a pair may come twice: a task only asks whether it is there
        cells = cells.unionByName(
            given.select(
                F.lit(PAIR).alias("kind"),
                user_block.alias("user_block"),
                item_block.alias("item_block"),
                "user_id",
                "item_id",
                no_vec.alias("vec"),
            )
        )
    fields = [
        T.StructField("user_id", user_type), T.StructField("item_id", item_type), T.StructField("score", T.DoubleType()),
        T.StructField("item_rank", T.IntegerType()),
    ]
    more = [] if marked is None else ["marked"]
    schema = T.StructType(fields + [T.StructField(c, T.BooleanType()) for c in more])
    cells = cells.withColumn("cell", F.col("user_block") * item_blocks + F.col("item_block"))
    cells = by_cell(cells.drop("user_block", "item_block"), user_blocks * item_blocks)
    # within a cell users come first, then pairs, then items by id
    cells = cells.sortWithinPartitions("cell", "kind", F.asc_nulls_last("item_id"))
    lists = cells.groupBy("cell").applyInArrow(_cell(scorer, k, digits, ceiling, marked is not None), schema)
    if item_blocks == 1:  # lists are whole
        return lists.select("user_id", "item_rank", "item_id", "score", *more)
    return rank_items(lists.drop("item_rank"), k, *more)


def dot_scorer(offset: float = 0.0, clip: tuple[float, float] | None = None) -> Scorer:
    """Inner products plus a constant, kept within the rating scale if one is given."""
    return DotScorer(offset, clip)
