"""One task per block of work."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.session import durable

MOST_PARTITIONS = 20_000


def by_cell(df: DataFrame, cells: int, cell: str = "cell") -> DataFrame:
    """Shuffle so that each cell (0 to ``cells`` - 1) is a partition of its own.

    Cells are small in bytes and heavy in work, so they must not be merged by size; a stated number of
    partitions is left alone by adaptive execution. A following ``groupBy(cell)`` needs no second shuffle.
    """
    if cells > MOST_PARTITIONS:
        return df.repartition(MOST_PARTITIONS, cell)
    return df.repartitionById(cells, F.col(cell))


def heavy_rows(df: DataFrame, rows_per_task: int, *by: str) -> DataFrame:
    """Rows that each cost much work, in as many tasks as their number asks for, whatever their bytes."""
    rows = durable(df)
    tasks = max(2 * df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / rows_per_task))
    return rows.repartition(min(tasks, MOST_PARTITIONS), *by)
