"""Approximate nearest neighbours by multiprobe p-stable hashing.

Unit vectors, so that the nearest by Euclid is the nearest by cosine. Each of L
tables hashes a vector by K random projections h_i = floor((a_i . v + b_i) / w).
A query visits its own bucket and then, in every table, the T perturbations of
it (some h_i one up or down) that are likeliest to hold near vectors: in order of
the summed squared distances to the edges crossed. The points of a bucket meet the
queries that visit it in blocks, as a matrix product, of which each query's best
few leave; those of all tables are merged and ranked by the exact measure on the
original vectors.

K and w are the ones that visit the least of a bounded sample at the recall that
is asked for. (Vectors without structure have no near neighbours to speak of;
then K comes out small and much of the table is visited.)

Equal vectors are one point with its k + 1 least ids; these are all that can
appear in a list of k. So hot points cost no more than others.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.grid import Side, blocked, cells, over_cells
from .common import Scratch, table, tidy

_STEP = np.uint64(0x9E3779B97F4A7C15)


def perturbations(edges: np.ndarray, count: int) -> list[list[tuple[int, int]]]:
    """The ``count`` cheapest sets of (projection, step) but the empty one; ``edges``: distance to the lower edge, in widths.

    A set costs the sum of its squared distances and has each projection once.
    """
    k = len(edges)
    moves = sorted([(float(x) ** 2, i, -1) for i, x in enumerate(edges)] + [(float(1 - x) ** 2, i, 1) for i, x in enumerate(edges)])
    out: list[list[tuple[int, int]]] = []
    heap = [(moves[0][0], (0,))] if k else []
    while heap and len(out) < count:
        cost, chosen = heapq.heappop(heap)
        if len({moves[j][1] for j in chosen}) == len(chosen):
            out.append([moves[j][1:] for j in chosen])
        last = chosen[-1]
        if last + 1 < len(moves):
            heapq.heappush(heap, (cost + moves[last + 1][0], (*chosen, last + 1)))
            heapq.heappush(heap, (cost - moves[last][0] + moves[last + 1][0], (*chosen[:-1], last + 1)))
    return out


class Hashes:
    """L tables of K projections, from a seed."""

    def __init__(self, dim: int, tables: int, projections: int, width: float, seed: int = 20):
        rng = np.random.default_rng(seed)
        self.tables, self.k = tables, projections
        self.a = rng.standard_normal((dim, tables * projections)) / width
        self.b = rng.random(tables * projections)
        self.salt = rng.integers(1, 2**63, (tables, projections)).astype(np.uint64) | np.uint64(1)

    def places(self, unit: np.ndarray) -> np.ndarray:
        return (unit @ self.a + self.b).reshape(len(unit), self.tables, self.k)

    def visits(self, unit: np.ndarray, probes: int) -> list[np.ndarray]:
        """The buckets that each of the rows visits: its own and ``probes`` perturbations in each table."""
        place = self.places(unit)
        cells = np.floor(place)
        out = []
        for i in range(len(cells)):
            sets = [perturbations(place[i, t] - cells[i, t], probes) for t in range(self.tables)]
            tried = np.repeat(cells[i][None], 1 + max(map(len, sets)), axis=0)
            for t, own in enumerate(sets):
                for j, moves in enumerate(own, 1):
                    for p, step in moves:
                        tried[j, t, p] += step
            out.append(np.unique(self.buckets(tried).ravel()))
        return out

    def buckets(self, cells: np.ndarray) -> np.ndarray:
        """Cells (n, tables, k) to bucket numbers (n, tables); the table is part of the number."""
        h = (cells.astype(np.int64).view(np.uint64) * self.salt).sum(axis=2, dtype=np.uint64)
        h += np.arange(1, self.tables + 1, dtype=np.uint64) * _STEP
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(29))).view(np.int64)


def _usable(column):
    """Vectors with a finite number in every place, and one that is not zero."""
    fine = ~F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return column.isNotNull() & fine & F.exists(column, lambda x: x != 0)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    tables: int = 10,
    probes: int = 50,
    recall: float = 0.93,
    fit_rows: int = 2_000,
    block: int = 50_000,
    seed: int = 20,
    hashed_dims: int = 16,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's ``k`` nearest of the candidates found.

    ``vectors``: vec_id, embedding; ``queries``: a part of its rows. Nearness is
    the cosine in double precision, ties to the smaller vec_id; a query is no
    candidate of its own. Null and zero vectors, those that hold null or
    non-finite numbers, and rows of null id take no part. Vectors of different
    lengths are no neighbours; those of each of the ``hashed_dims`` commonest lengths have
    hashes of their own, fitted to ``fit_rows`` rows, and every point is indexed. Rows of
    other lengths, and queries that find fewer than ``k`` candidates though there are
    more, are compared with all points of their length, in blocks. Rows that repeat one
    id and vector count once. ``block``: points that meet in one task, and visits, about.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    column = F.col("embedding").cast("array<double>")

    def clean(df: DataFrame) -> DataFrame:
        rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), column.alias("v"))
        return rows.where(F.col("vec_id").isNotNull() & _usable(F.col("v")))

    key = F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b")).alias("point")
    rows = clean(vectors).select("vec_id", key, "v")
    least = F.dense_rank().over(Window.partitionBy("point").orderBy("vec_id"))
    ids = rows.select("point", "vec_id").withColumn("r", least).where(F.col("r") <= k + 1).select("point", "vec_id")
    ids = scratch.write(ids.distinct())
    points = rows.groupBy("point").agg(F.first("v").alias("v"), F.min("vec_id").alias("least"), F.count_distinct("vec_id").alias("copies"))
    points = scratch.write(points.withColumn("dim", F.size("v")))
    asked = scratch.write(clean(queries).select(F.col("vec_id").alias("query_id"), key).distinct())
    asked_points = scratch.write(points.join(asked.select("point"), "point", "left_semi").select("point", "v", "dim"))
    dims = points.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(hashed_dims).collect()
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    met = _scanned(*(df.where(~F.col("dim").isin([r.dim for r in dims])) for df in (points, asked_points)), k)
    for r in dims:
        own, tried = (df.where(F.col("dim") == r.dim) for df in (points, asked_points))
        sample = own.orderBy(F.xxhash64(F.lit(seed), "least")).limit(fit_rows).select("v").collect()
        hashes = fit(_unit(np.array([x.v for x in sample])), tables, probes, recall, k, seed)
        met = met.unionByName(_hashed(scratch, own, tried, hashes, probes, k, block))
    out = scratch.write(_named(_ranked(met, points, asked_points, k), asked, ids, k))
    # Queries that found too few though there are more.
    sizes = F.broadcast(points.groupBy("dim").agg(F.sum("copies").alias("total")))  # a row a length
    of = asked.join(asked_points.select("point", "dim"), "point").join(sizes, "dim")
    short = of.join(out.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left")
    short = short.where(F.coalesce("n", F.lit(0)) < F.least(F.lit(k), F.col("total") - 1))
    short = scratch.write(short.select("query_id", "point"))
    if not short.count():
        return out
    missing = asked_points.join(short.select("point"), "point", "left_semi")
    extra = _named(_ranked(_scanned(points, missing, k), points, missing, k), short, ids, k)
    return out.join(short, "query_id", "left_anti").unionByName(extra)


_POINT = "struct<a: bigint, b: bigint>"


def _hashed(scratch: Scratch, points: DataFrame, asked: DataFrame, hashes: Hashes, probes: int, k: int, block: int) -> DataFrame:
    """asked, point, score: of the points in the buckets that each asked one visits its best ones, by bucket.

    Buckets of more than ``block`` points or visits are cut into parts of both, which meet
    as a grid; others go to tasks together.
    """
    dim, tables = hashes.a.shape[0], hashes.tables

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = hashes.buckets(np.floor(hashes.places(_unit(_matrix(batch.column(1), dim)))))
            at = pa.array(np.repeat(np.arange(batch.num_rows), tables))
            arrays = [pa.array(bucket.ravel()), batch.column(0).take(at), batch.column(1).take(at)]
            yield pa.RecordBatch.from_arrays(arrays, ["bucket", "point", "v"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                found = hashes.visits(_unit(_matrix(part.column(1), dim)), probes)
                at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
                arrays = [pa.array(np.concatenate(found)), part.column(0).take(at), part.column(1).take(at)]
                yield pa.RecordBatch.from_arrays(arrays, ["bucket", "asked", "q"])

    stored = scratch.write(points.select("point", "v").mapInArrow(tidy(index), f"bucket long, point {_POINT}, v array<double>"))
    tried = scratch.write(asked.select("point", "v").mapInArrow(tidy(visit), f"bucket long, asked {_POINT}, q array<double>"))
    counts = stored.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).join(tried.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")), "bucket")
    cuts = {c: F.ceil(F.col(c) / block).cast("int").alias(f"{c}_cuts") for c in ("n", "m")}
    # Buckets larger than a block: at most as many as there are blocks of all entries.
    large = scratch.write(counts.where((F.col("n") > block) | (F.col("m") > block)).select("bucket", *cuts.values()))
    small = max(1, round((stored.count() + tried.count()) / block))
    few = large.count() <= 100_000

    def dealt(df: DataFrame, name: str, own: str, other: str) -> DataFrame:
        df = df.join(F.broadcast(large) if few else large, "bucket", "left")
        mine = F.pmod(F.xxhash64(F.lit(3), name), F.coalesce(own, F.lit(1))).cast("int")
        df = df.withColumn("mine", mine).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)))
        place = (F.col("bucket"), F.col("mine"), F.col("theirs")) if own == "n_cuts" else (F.col("bucket"), F.col("theirs"), F.col("mine"))
        part = F.when(F.col("n_cuts").isNull(), F.pmod(F.xxhash64("bucket"), F.lit(small))).otherwise(F.xxhash64(*place))
        return df.withColumn("part", part).withColumn("cell", F.xxhash64(*place)).drop("mine", "theirs", "n_cuts", "m_cuts")

    def meet(right: pa.Table, left: pa.Table) -> pa.Table:
        found = _Best(k)
        if left.num_rows and right.num_rows:
            left, right = (x.sort_by("cell").combine_chunks() for x in (left, right))
            v, q = (_unit(_matrix(x[c].chunk(0), dim)) for x, c in ((left, "v"), (right, "q")))
            cell, own = np.unique(right["cell"].to_numpy(), return_index=True)
            held = left["cell"].to_numpy()
            for c, i, j in zip(cell, own, np.append(own[1:], right.num_rows), strict=True):
                a, b = np.searchsorted(held, c, "left"), np.searchsorted(held, c, "right")
                for at in range(i, j, 256):  # products of a few megabytes
                    for start in range(a, b, 8_192):
                        found.add(q[at : min(at + 256, j)] @ v[start : min(start + 8_192, b)].T, at, start)
                found.settle(i)
        return found.table(right, left)

    stored = dealt(stored, "point", "n_cuts", "m_cuts").select("part", "cell", "point", "v")
    tried = dealt(tried, "asked", "m_cuts", "n_cuts").select("part", "cell", "asked", "q")
    return tried.groupBy("part").cogroup(stored.groupBy("part")).applyInArrow(meet, f"asked {_POINT}, point {_POINT}, score double")


class _Best:
    """The k + 1 best points of each row of some products, and those that tie with the last."""

    def __init__(self, k: int):
        self.k, self.q, self.p, self.s = k, [], [], []
        self.settled = 0

    def add(self, near: np.ndarray, first_q: int, first_p: int) -> None:
        m = min(self.k + 1, near.shape[1])
        cut = -np.partition(-near, m - 1, axis=1)[:, m - 1 : m]
        i, j = np.nonzero(near >= cut - 1e-12)
        self.q.append(i + first_q)
        self.p.append(j + first_p)
        self.s.append(near[i, j])

    def settle(self, first_q: int) -> None:
        """Of what was added since for rows from ``first_q`` on, keeps each row's best only."""
        if len(self.q) - self.settled > 1:
            q, p, s = (np.concatenate(x[self.settled :]) for x in (self.q, self.p, self.s))
            order = np.lexsort((-s, q))
            q, p, s = q[order], p[order], s[order]
            first = np.searchsorted(q, q)
            last = np.minimum(first + self.k, np.searchsorted(q, q, "right") - 1)
            keep = s >= s[last] - 1e-12
            for x, new in ((self.q, q), (self.p, p), (self.s, s)):
                x[self.settled :] = [new[keep]]
        self.settled = len(self.q)

    def table(self, asked: pa.Table, points: pa.Table) -> pa.Table:
        q, p, s = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((self.q, int), (self.p, int), (self.s, float)))
        return pa.table([asked["asked"].take(pa.array(q)), points["point"].take(pa.array(p)), pa.array(s)], ["asked", "point", "score"])


def fit(sample: np.ndarray, tables: int, probes: int, recall: float, k: int, seed: int, asked: int = 48) -> Hashes:
    """The hashes that visit least of the sample (unit rows) and still find ``recall`` of the k nearest in it."""
    dim = sample.shape[1]
    if len(sample) <= 4 * k:
        return Hashes(dim, tables, 1, 8.0, seed)
    asked = min(asked, len(sample))
    cos = sample[:asked] @ sample.T
    cos[np.arange(asked), np.arange(asked)] = -2
    near = np.argsort(-cos, axis=1)[:, :k]
    apart = math.sqrt(max(1e-3, 2 - 2 * float(np.take_along_axis(cos, near, 1).mean())))
    best = None
    for width in (apart, 2 * apart):
        for projections in (2, 3, 4, 5, 6, 8, 10, 12, 16, 20):
            hashes = Hashes(dim, tables, projections, width, seed)
            bucket = hashes.buckets(np.floor(hashes.places(sample)))
            found = [np.isin(bucket, x).any(axis=1) for x in hashes.visits(sample[:asked], probes)]
            got = np.mean([f[o].mean() for f, o in zip(found, near, strict=True)])
            if got < recall:
                break
            share = np.mean([f.mean() for f in found])
            if best is None or share < best[0]:
                best = share, hashes
    return best[1] if best else Hashes(dim, tables, 1, 2 * apart, seed)


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _score(a: str, b: str):
    return _dot(a, b) / (F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def _ranked(met: DataFrame, points: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """asked, point, score: of the pairs met, each asked point's k + 1 best, and those that tie with the last."""
    pairs = met.groupBy("asked", "point").agg(F.max("score").alias("rough"))
    order = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("rough")))
    worst = F.max(F.when(F.col("r") == k + 1, F.col("rough"))).over(Window.partitionBy("asked"))
    best = pairs.withColumn("r", order).withColumn("worst", worst)
    best = best.where(F.col("worst").isNull() | (F.col("rough") >= F.col("worst") - 1e-12))
    return (
        best.select("asked", "point")
        .join(points.select("point", "v"), "point")
        .join(asked.select(F.col("point").alias("asked"), F.col("v").alias("q")), "asked")
        .select("asked", "point", _score("q", "v").alias("score"))
    )


def _named(top: DataFrame, asked: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    rows = asked.withColumnRenamed("point", "asked").join(top, "asked").join(ids, "point").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _scanned(points: DataFrame, missing: DataFrame, k: int) -> DataFrame:
    """Every point against the asked ones of its length, blocks by blocks: asked, point, score."""

    def scan(p: Side, q: Side) -> pa.RecordBatch:
        found = _Best(k)
        found.add(_unit(q.matrix) @ _unit(p.matrix).T, 0, 0)
        return found.table(pa.table([q.field("point")], ["asked"]), pa.table([p.field("point")], ["point"])).combine_chunks().to_batches()[0]

    met = cells(blocked(points.select("point", "v"), "v", "point"), blocked(missing.select("point", "v"), "v", "query", most=256))
    return over_cells(met, f"asked {_POINT}, point {_POINT}, score double", scan, "v")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every vector of ``embeddings`` whose id 50 divides."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))
