"""Inverted-file index of vectors: a coarse quantiser, a table partitioned by its cells, and probes.

The quantiser (spherical k-means) is trained on a bounded sample; every vector goes to
the cell of its nearest centroid, and the table lies in a folder for each cell, so that
a search reads the folders of the probed cells only. How many cells a query probes is
the least number that reaches the recall asked for on the sample. Queries whose cells
are poor (fewer than k found) go on to all others; an exact search goes on to the cells
that may hold something better still: the centroid's angle less the cell's radius
bounds the angle of all that lies in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dense import SCORED, as_matrix, named_best, unit
from .grid import Side, blocked_by, cells, over_cells
from .sparse import top_k

FIELDS = ("slots", "weights")


@dataclass(frozen=True)
class InvertedFile:
    """How to build and search: ``cells`` (None: as many as the root of the number of vectors, 1,024 at most), sample rows,
    the recall that probing reaches on the sample, and whether searches are exact."""

    cells: int | None = None
    sample: int = 20_000
    recall: float = 0.95
    exact: bool = False
    rounds: int = 8
    seed: int = 17
    k: int = 10

    def train(self, vectors: DataFrame, key: str = "chunk_id") -> Quantiser:
        """``vectors``: key, slots, weights. Learns from the ``sample`` rows of lowest hashes, in one task of a worker:
        the driver gets the centroids only."""
        n = vectors.count()
        wanted = self.cells or min(1024, max(1, round(n**0.5)))
        k, recall, rounds, seed = self.k, self.recall, self.rounds, self.seed

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = list(batches)
            dim = 1 + max((int(b.column(0).flatten().to_numpy().max(initial=0)) for b in held), default=0)
            parts = [as_matrix(b.column(0), b.column(1), dim) for b in held]
            x = unit(np.concatenate(parts) if parts else np.zeros((0, dim)))
            del held, parts
            centroids = _means(x, min(wanted, len(x)), rounds, seed)
            probes = _probes(x, centroids, k, recall)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(centroids) + 1) * centroids.shape[1], pa.int32()), pa.array(centroids.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centroids), dtype=np.int32)), pa.array(np.full(len(centroids), probes, np.int32)), rows], ["at", "probes", "centroid"])

        # Hashes lie evenly: below this bound are a few more rows than wanted, so that the task that sorts them gets as many of any table.
        hashed, few = F.xxhash64(F.lit(seed), key), self.sample + 10 * round(self.sample**0.5)
        rows = vectors if n <= few else vectors.where(hashed < F.lit((few << 64) // n - (1 << 63)))
        sample = rows.orderBy(hashed, key).limit(self.sample).select(*FIELDS).coalesce(1)
        made = sample.mapInArrow(learn, "at int, probes int, centroid array<double>").toArrow().sort_by("at")
        if not len(made):
            return Quantiser(np.zeros((1, 1)), 1)
        flat = made["centroid"].combine_chunks().flatten().to_numpy()
        return Quantiser(flat.reshape(len(made), -1), made["probes"][0].as_py())


@dataclass(frozen=True)
class Quantiser:
    centroids: np.ndarray
    probes: int

    def cosines(self, slots: pa.Array, weights: pa.Array) -> np.ndarray:
        """Of vectors and centroids; slots that no centroid has count in the vectors' lengths only."""
        wide = as_matrix(slots, weights, self.centroids.shape[1])
        return np.clip(unit(wide)[:, : self.centroids.shape[1]] @ self.centroids.T, -1, 1)


def _means(x: np.ndarray, n: int, rounds: int, seed: int) -> np.ndarray:
    """Centroids of unit length; a cell that is left empty takes the row farthest from its own."""
    if not len(x):
        return np.zeros((1, x.shape[1]))
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), n, replace=False)]
    for _ in range(rounds):
        near = x @ centroids.T
        own = near.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=n) == 0)
        if len(empty):
            sums[empty] = x[np.argsort(near.max(axis=1), kind="stable")[: len(empty)]]
        centroids = unit(sums)
    return centroids


def _probes(x: np.ndarray, centroids: np.ndarray, k: int, recall: float, asked: int = 200) -> int:
    """The least number of cells in which ``recall`` of the sample's own k nearest are found."""
    if len(x) <= k + 1:
        return len(centroids)
    q = x[: min(asked, len(x))]
    near = q @ x.T
    near[np.arange(len(q)), np.arange(len(q))] = -2
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    own = (x @ centroids.T).argmax(axis=1)
    place = np.argsort(np.argsort(-(q @ centroids.T), axis=1, kind="stable"), axis=1)
    at = np.sort(np.take_along_axis(place, own[best], 1).ravel())
    return int(at[min(len(at) - 1, int(np.ceil(recall * len(at))) - 1)]) + 1


def assigned(vectors: DataFrame, quantiser: Quantiser, key: str = "chunk_id") -> DataFrame:
    """``vectors`` (key, slots, weights) with ``cell`` and ``apart``, the angle between vector and centroid."""
    sent = vectors.sparkSession.sparkContext.broadcast(quantiser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2_048):
                part = batch.slice(start, 2_048)
                near = sent.value.cosines(part.column(1), part.column(2))
                cell = near.argmax(axis=1)
                apart = np.arccos(near[np.arange(len(cell)), cell])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(apart)], [key, *FIELDS, "cell", "apart"])

    return vectors.select(key, *FIELDS).mapInArrow(run, f"{key} string, slots array<int>, weights array<double>, cell int, apart double")


def write(rows: DataFrame, path: str, many: bool = True) -> None:
    """``rows`` with a column ``cell`` as a table of a folder for each cell; cells of many rows get several files. Not ``many``: one cell, written as it lies."""
    rows = rows.hint("rebalance", "cell") if many else rows
    rows.write.mode("overwrite").partitionBy("cell").parquet(path)


def radii(rows: DataFrame) -> dict[int, float]:
    """Of each cell that has rows: the greatest angle to its centroid. A row a cell."""
    return {r.cell: r.radius for r in rows.groupBy("cell").agg(F.max("apart").alias("radius")).collect()}


def _visited(queries: DataFrame, quantiser: Quantiser, held: dict[int, float], bounds: bool) -> DataFrame:
    """Each query (query_id, slots, weights) with ``cells``, the numbers of those that it visits: the nearest ones that have rows.

    If ``bounds``, the others instead, as far as they may hold what is nearer than ``floor``, the query's least score so far;
    ``queries`` have the cells visited before. A row a query: its vector isn't repeated for each cell.
    """
    sent = queries.sparkSession.sparkContext.broadcast((quantiser, np.array(sorted(held)), np.array([held[c] for c in sorted(held)])))
    columns = ["query_id", *FIELDS, "cells"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, cell, radius = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, 1_024):
                part = batch.slice(start, 1_024)
                near = q.cosines(part.column(1), part.column(2))[:, cell]
                visited = np.zeros(near.shape, bool)
                if bounds:
                    row, before = _flat(part.column(3))
                    visited[row, np.searchsorted(cell, before)] = True
                    most = np.cos(np.maximum(0, np.arccos(near) - radius - 1e-9))
                    visited = ~visited & (most >= part.column(4).to_numpy()[:, None] - 2e-6)
                else:
                    np.put_along_axis(visited, np.argsort(-near, axis=1, kind="stable")[:, : q.probes], True, axis=1)
                i, j = np.nonzero(visited)
                ends = pa.array(np.searchsorted(i, np.arange(part.num_rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.ListArray.from_arrays(ends, pa.array(cell[j].astype(np.int32)))], columns)

    rows = queries.select("query_id", *FIELDS, *(["cells", "floor"] if bounds else []))
    return rows.mapInArrow(run, "query_id string, slots array<int>, weights array<double>, cells array<int>").where(F.size("cells") > 0)


def _visits(queries: DataFrame, quantiser: Quantiser, held: dict[int, float], bounds: bool) -> DataFrame:
    """(query_id, cell) of ``_visited``."""
    return _visited(queries, quantiser, held, bounds).select("query_id", F.explode("cells").alias("cell"))


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of lists of numbers."""
    return np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()


def _dealt(asked: DataFrame, cell: np.ndarray, shelf: np.ndarray) -> DataFrame:
    """Queries with ``cells``, a row for each shelf that has some of these. ``cell``, ascending, with its ``shelf``; others have no rows."""
    step = max(1, 16_384 // len(np.unique(shelf)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                row, number = _flat(part.column(3))
                known = np.isin(number, cell)
                row, number = row[known], number[known]
                on = shelf[np.searchsorted(cell, number)]
                _, first = np.unique(row * (1 + shelf[-1]) + on, return_index=True)
                cells = pa.ListArray.from_arrays(pa.array(np.r_[first, len(row)].astype(np.int32)), pa.array(number))
                rows = [c.take(pa.array(row[first])) for c in part.columns[:3]]
                yield pa.RecordBatch.from_arrays([*rows, cells, pa.array(on[first])], ["query_id", *FIELDS, "cells", "shelf"])

    return asked.mapInArrow(run, "query_id string, slots array<int>, weights array<double>, cells array<int>, shelf long")


def _met(vectors: DataFrame, asked: DataFrame, k: int, digits: int, size: int = 4 << 20) -> DataFrame | None:
    """(query_id, chunk_id, score) of the vectors in the ``cells`` that queries visit; None where they visit none. The cells visited are a filter of the scan.

    Cells next to each other make a shelf of about ``size`` bytes, and a query is sent to a shelf once, with its cells' numbers there.
    """
    wanted = [r.cell for r in asked.select(F.explode("cells").alias("cell")).distinct().collect()]  # as many as the quantiser has
    if not wanted:
        return None
    spark = vectors.sparkSession
    rows = vectors.where(F.col("cell").isin(wanted)).select("chunk_id", *FIELDS, "cell")
    counts = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("slots")).alias("width")).toArrow().sort_by("cell")
    if not len(counts):
        return spark.createDataFrame([], SCORED)
    cell, n, width = (c.to_numpy() for c in counts.columns)
    per = int(np.clip(size * n.sum() // (12 * max(1, width.sum())), 256, 8_192))
    shelf = (np.cumsum(n) - n) // per
    some = np.unique(shelf)
    sizes = spark.createDataFrame(pa.table({"shelf": some, "n": np.bincount(np.searchsorted(some, shelf), n).astype(np.int64)}))
    rows = rows.join(F.broadcast(spark.createDataFrame(pa.table({"cell": cell, "shelf": shelf}))), "cell")
    points = blocked_by(rows, ["shelf"], "point", per, sizes)
    asked = blocked_by(_dealt(asked, cell, shelf), ["shelf"], "query", 512)

    def product(p: Side, q: Side) -> pa.RecordBatch:
        dim = 1 + max(int(x.field("slots").flatten().to_numpy().max(initial=0)) for x in (p, q))
        a, b = (unit(as_matrix(x.field("slots"), x.field("weights"), dim)) for x in (p, q))
        own, (row, seen) = p.numbers("cell"), _flat(q.field("cells"))
        by_cell, by_seen = np.argsort(own, kind="stable"), np.argsort(seen, kind="stable")
        scores = np.zeros((len(q), len(p)))  # what a query doesn't visit stays 0, and goes
        for c in np.unique(own):
            j = by_cell[slice(*np.searchsorted(own, [c, c + 1], sorter=by_cell))]
            i = row[by_seen[slice(*np.searchsorted(seen, [c, c + 1], sorter=by_seen))]]
            scores[np.ix_(i, j)] = np.round(b[i] @ a[j].T, digits)
        return named_best(p, q, scores, k)

    return over_cells(cells(points, asked, ["shelf"]), SCORED, product, None)


def search(vectors: DataFrame, quantiser: Quantiser, held: dict[int, float], queries: DataFrame, k: int, exact: bool = False, digits: int = 12, cut=lambda df: df) -> DataFrame:
    """(query_id, chunk_id, score, rank) by cosine; only positive scores, ties to the least chunk_id.

    ``vectors``: chunk_id, slots, weights, cell (a partition column); ``held``: radii of its
    cells; ``queries``: query_id, slots, weights. ``cut`` writes a step down.
    """
    if not held:
        return top_k(queries.sparkSession.createDataFrame([], SCORED), k)
    asked = cut(_visited(queries, quantiser, held, False))
    first = _met(vectors, asked, k, digits)
    if first is None:  # no queries
        return top_k(queries.sparkSession.createDataFrame([], SCORED), k)
    found = cut(top_k(first, k))
    least = found.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    # Merged, not sent out: sizes of files say little of the rows in them, which may be repeated ones.
    rest = asked.join(least.hint("merge"), "query_id", "left").withColumn("floor", F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(-2.0)))
    rest = rest if exact else rest.where(F.col("floor") == -2.0)
    more = _met(vectors, cut(_visited(rest, quantiser, held, True)), k, digits)
    return found if more is None else top_k(found.drop("rank").unionByName(more), k)


def from_arrays(vectors: DataFrame, key: str, column: str, to: str) -> DataFrame:
    """(``to``, slots, weights) of plain arrays; null and empty ones are left out."""
    x = F.col(column).cast("array<double>")
    return vectors.where(F.size(column) > 0).select(F.col(key).cast("string").alias(to), F.sequence(F.lit(0), F.size(column) - 1).alias("slots"), x.alias("weights"))
