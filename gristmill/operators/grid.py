"""Grid join of vectors: blocks of queries meet blocks of points, each pair of blocks once.

Both sides are tables of blocks, dealt out by a hash of their rows; the smaller side,
the queries, is copied to every block of points. A cell's work is bounded by bytes,
and no side is collected or broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blocked(rows: DataFrame, vec: str, name: str, size: int = 2 << 20, most: int = 8_192) -> DataFrame:
    """(dim, ``name`` (number of the block), ``name``_rows): ``rows`` in blocks of equal dimension.

    A block has about ``size`` bytes of numbers, or ``most`` rows. ``vec``: the column
    that is the vector, an array. Rows should differ, as equal ones meet in one block.
    """
    per = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.lit(size) / (8 * F.greatest("dim", F.lit(1))))))
    return blocked_by(rows.withColumn("dim", F.size(vec)), ["dim"], name, per)


def blocked_by(rows: DataFrame, by: list[str], name: str, per: Column | int, counts: DataFrame | None = None) -> DataFrame:
    """(``by``, ``name``, ``name``_rows): ``rows`` in blocks of about ``per`` with the same ``by``, of which there are few values.

    ``counts`` (``by``, n): how many rows these have, where that is known.
    """
    per = F.lit(per) if isinstance(per, int) else per
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    counts = counts.select(*by, F.ceil(F.col("n") / per).cast("long").alias("n_blocks"))
    # A row for each value of ``by``: lengths of vectors, or cells of an index.
    rows = rows.join(F.broadcast(counts), by)
    kept = [c for c in rows.columns if c not in (*by, "n_blocks")]
    number = F.pmod(F.xxhash64(F.lit(name), *kept), F.col("n_blocks")).alias(name)
    out = rows.groupBy(*by, number).agg(F.collect_list(F.struct(*kept)).alias(f"{name}_rows"))
    out._counts = counts
    return out


def cells(points: DataFrame, queries: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(``by``, point, query, point_rows, query_rows): every block of points with every block of queries of the same ``by``.

    The numbers of the blocks of points are sent out. The blocks are merged: Spark would send out a side whose files are small,
    through the driver, though its rows may be many times larger where they repeat each other.
    """
    by = by or ["dim"]
    counts = getattr(points, "_counts", None)  # blocks that are a table by now are read instead: their numbers only
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("point")
    places = points.select(*by, "point") if counts is None else counts.select(*by, numbers)
    sent = queries.join(F.broadcast(places), by).select(*by, "point", *(c for c in queries.columns if c not in by))
    return points.join(sent.hint("merge"), [*by, "point"])


class Side:
    """One side of a cell: its rows' fields as arrays, its vectors as a matrix."""

    def __init__(self, rows: pa.Array, vec: str | None = "vec", dtype=np.float64):
        self.rows = rows.flatten() if isinstance(rows, pa.ListArray) else rows
        if vec:
            flat = self.rows.field(vec).flatten().to_numpy(zero_copy_only=False)
            self.matrix = flat.astype(dtype, copy=False).reshape(len(self.rows), -1)

    def __len__(self) -> int:
        return len(self.rows)

    def field(self, name: str) -> pa.Array:
        return self.rows.field(name)

    def numbers(self, name: str) -> np.ndarray:
        return self.rows.field(name).to_numpy(zero_copy_only=False)


def over_cells(met: DataFrame, schema: str, work: Callable[[Side, Side], pa.RecordBatch], vec: str | None = "vec", dtype=np.float64) -> DataFrame:
    """``work(points, queries)`` of every cell, as rows of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cell = batch.slice(i, 1)
                yield work(*(Side(cell.column(f"{n}_rows"), vec, dtype) for n in ("point", "query")))

    return met.select("point_rows", "query_rows").mapInArrow(run, schema)


def best(scores: np.ndarray, k: int, valid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the ``k`` highest scores of every row, of ties the first columns; only where ``valid``."""
    n, m = scores.shape
    if not n or not m:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    shown = scores if valid is None else np.where(valid, scores, -np.inf)
    cut = np.partition(shown, max(0, m - k), axis=1)[:, max(0, m - k)]
    keep = shown >= cut[:, None]
    if valid is not None:
        keep &= valid
    i, j = np.nonzero(keep)
    order = np.lexsort((j, -shown[i, j], i))
    i, j = i[order], j[order]
    first = np.searchsorted(i, np.arange(n))
    keep = np.arange(len(i)) - first[i] < k
    return i[keep], j[keep]
