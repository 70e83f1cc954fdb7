"""Hard negatives by distributed radix selection.

Every anchor has its nearest rows of the same label as positives. A pair of anchor
and positive opens a window of scores, from a share of the positive's score up to
another; wanted are the window's first k rows of other labels. No list is sorted for
that: blocks of anchors meet blocks of rows in a grid, each cell counts its scores in
buckets by their highest digit, the counts of all cells are added up and show in which
bucket the k-th row lies; that bucket is counted by the next digit, until the k-th
score is known. Then only the rows up to it are gathered.

A cell reports buckets only as far as its own counts reach k; the k-th row of all
lies no later, so what it leaves out changes nothing. Of rows that tie with the k-th
a cell sends as many as are wanted of all, those of least ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.grid import Side, best, blocked, cells, over_cells
from .common import Scratch, table

BITS = 8


def whole_vectors(column, scale: int):
    """Components times ``scale``, rounded down; null where the vector or a component is null or not finite."""
    x = column.cast("array<double>")
    fine = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(fine, F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def mine(
    vectors: DataFrame,
    anchors,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    anchor_block: int = 256,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    ``vectors``: vec_id, label, embedding; ``anchors``: a condition on vec_id. A score is
    the inner product of two rows' components, each times ``scale`` and rounded down.
    Higher scores come first, ties by smaller vec_id. An anchor's positives are its first
    ``positives`` other rows of its label; with each come the first ``negatives`` rows of
    other labels whose score is ``low`` to ``high`` percent of the positive's. Windows
    that hold none give no row.

    Rows of null vec_id, label or vector, or with a null or non-finite component, take no
    part. Rows that repeat one vec_id count once, as that of least label and vector. Rows
    of another dimension than the anchor's have no score with it; an empty vector scores
    0 with others. Scores must fit a long (with a factor of 100 to spare), else a
    ValueError says so. Other columns are dropped.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), whole_vectors(F.col("embedding"), scale).alias("vec"))
    rows = rows.dropna().groupBy("id").agg(F.min(F.struct("label", "vec")).alias("row")).select("id", "row.*")
    rows = scratch.write(rows)
    top = rows.agg(F.max(F.array_max(F.transform("vec", lambda x: F.abs(x).cast("double")))).alias("top"), F.max(F.size("vec")).alias("dim")).first()
    bound = (top.dim or 0) * (top.top or 0) ** 2
    if bound * max(100, low, high) >= 2**63:
        raise ValueError("inner products of these vectors don't fit a long")
    kind = np.float64 if bound < 2**53 else np.int64  # floats are exact up to there, and faster
    asked = rows.where(anchors(F.col("id")))
    points = scratch.write(blocked(rows, "vec", "point"))

    def near(p: Side, q: Side) -> pa.RecordBatch:
        p_ids, q_ids, p_labels, q_labels, scores, order = _met(p, q)
        valid = (p_labels == q_labels[:, None]) & (p_ids != q_ids[:, None])
        i, j = best(scores, positives, valid)
        return pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(p_ids[j]), pa.array(scores[i, j].astype(np.int64))], ["anchor_id", "positive_id", "positive_score"])

    found = over_cells(cells(points, blocked(asked, "vec", "query", most=anchor_block)), "anchor_id long, positive_id long, positive_score long", near, dtype=kind)
    order = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    found = found.withColumn("r", order).where(F.col("r") <= positives).drop("r")
    windows = found.withColumns({"lo": F.col("positive_score") * low, "hi": F.col("positive_score") * high})
    windows = windows.withColumns({"lo": F.expr("(lo + pmod(-lo, 100L)) div 100L"), "hi": F.expr("(hi - pmod(hi, 100L)) div 100L")})  # up, and down
    # Places in a window count down from its upper end.
    windows = windows.where("lo <= hi").select("anchor_id", "positive_id", "positive_score", "hi", (F.col("hi") - F.col("lo")).alias("width"))
    windows = scratch.write(windows.withColumns({"prefix": F.lit(0).cast("long"), "need": F.lit(negatives).cast("long"), "whole": F.lit(False)}))
    widest = windows.agg(F.max("width")).first()[0] or 0
    digits = max(1, -(-int(widest).bit_length() // BITS))

    for shift in range(BITS * (digits - 1), -1, -BITS):
        counts = over_cells(cells(points, _with_windows(asked, windows.where(~F.col("whole")), anchor_block)), "anchor_id long, positive_id long, digit int, n long", _counter(shift), dtype=kind)
        counts = counts.groupBy("anchor_id", "positive_id", "digit").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("anchor_id", "positive_id").orderBy("digit"))
        counts = counts.withColumn("upto", upto).join(windows.select("anchor_id", "positive_id", "need"), ["anchor_id", "positive_id"])
        reached = counts.where(F.col("upto") >= F.col("need")).groupBy("anchor_id", "positive_id")
        reached = reached.agg(F.min(F.struct("digit", (F.col("upto") - F.col("n")).alias("before"))).alias("at"))
        windows = windows.join(reached, ["anchor_id", "positive_id"], "left").withColumn("whole", F.col("whole") | F.col("at").isNull())
        windows = windows.withColumns(
            {
                "prefix": F.when(~F.col("whole"), F.col("prefix") * (1 << BITS) + F.col("at.digit")).otherwise(F.col("prefix")),
                "need": F.when(~F.col("whole"), F.col("need") - F.col("at.before")).otherwise(F.col("need")),
            }
        )
        windows = scratch.write(windows.drop("at"))

    # All of a window that holds fewer than k; else the rows before the k-th score and the first of those that tie.
    windows = windows.withColumn("prefix", F.when(F.col("whole"), F.col("width") + 1).otherwise(F.col("prefix")))
    schema = "anchor_id long, positive_id long, negative_id long, negative_score long"
    out = over_cells(cells(points, _with_windows(asked, windows, anchor_block)), schema, _gather, dtype=kind)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    out = out.withColumn("rank", rank).where(F.col("rank") <= negatives)
    out = out.join(windows.select("anchor_id", "positive_id", "positive_score"), ["anchor_id", "positive_id"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _with_windows(asked: DataFrame, windows: DataFrame, most: int) -> DataFrame:
    """Blocks of anchors, each with its windows."""
    own = windows.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("positive_id", "hi", "width", "prefix", "need")).alias("windows"))
    return blocked(asked.join(own, "id"), "vec", "query", most=most)


def _met(p: Side, q: Side):
    """Ids and labels of both sides and their scores, the points in order of ids."""
    order = np.argsort(p.numbers("id"), kind="stable")
    scores = q.matrix @ p.matrix[order].T
    return p.numbers("id")[order], q.numbers("id"), p.numbers("label")[order], q.numbers("label"), scores, order


def _windows(q: Side):
    """For each anchor, the range of its windows among all windows' fields."""
    lists = q.field("windows")
    flat = lists.flatten()
    ends = np.cumsum(np.asarray([0, *(len(x) for x in lists)]))
    return ends, {n: flat.field(n).to_numpy(zero_copy_only=False) for n in ("positive_id", "hi", "width", "prefix", "need")}


def _others(p: Side, q: Side):
    """For each anchor: its number, and ids and scores of the rows of other labels, higher scores first, then smaller ids."""
    p_ids, _, p_labels, q_labels, scores, _ = _met(p, q)
    for i in range(len(q)):
        other = np.flatnonzero(p_labels != q_labels[i])
        own = scores[i, other].astype(np.int64)
        order = np.argsort(-own, kind="stable")
        yield i, p_ids[other[order]], own[order]


def _counter(shift: int):
    """Counts by the digit at ``shift`` of places in the windows, as far as what a window still needs."""

    def count(p: Side, q: Side) -> pa.RecordBatch:
        q_ids = q.numbers("id")
        ends, w = _windows(q)
        out = []
        for i, _, scores in _others(p, q):
            for at in range(ends[i], ends[i + 1]):
                first = int(w["prefix"][at]) << shift + BITS
                last = min(first + (1 << shift + BITS), int(w["width"][at]) + 1)  # places first..last-1
                a, b = np.searchsorted(-scores, [first - w["hi"][at], last - w["hi"][at]])
                if a < b:
                    n = np.bincount((w["hi"][at] - scores[a:b] - first) >> shift)
                    n = n[: int(np.searchsorted(np.cumsum(n), w["need"][at])) + 1]
                    d = np.flatnonzero(n)
                    out.append((np.full(len(d), q_ids[i]), np.full(len(d), w["positive_id"][at]), d.astype(np.int32), n[d]))
        return _batch(out, ["anchor_id", "positive_id", "digit", "n"], [np.int64, np.int64, np.int32, np.int64])

    return count


def _gather(p: Side, q: Side) -> pa.RecordBatch:
    """The rows of each window before its last place, and the first of those at it."""
    q_ids = q.numbers("id")
    ends, w = _windows(q)
    out = []
    for i, ids, scores in _others(p, q):
        for at in range(ends[i], ends[i + 1]):
            last = w["prefix"][at]
            a, b, c = np.searchsorted(-scores, [-w["hi"][at], last - w["hi"][at], last - w["hi"][at] + 1])
            c = min(c, b + w["need"][at]) if last <= w["width"][at] else b
            if a < c:
                out.append((np.full(c - a, q_ids[i]), np.full(c - a, w["positive_id"][at]), ids[a:c], scores[a:c]))
    return _batch(out, ["anchor_id", "positive_id", "negative_id", "negative_score"], [np.int64] * 4)


def _batch(parts: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    columns = [np.concatenate(x).astype(t) for x, t in zip(zip(*parts, strict=True), kinds, strict=True)] if parts else [np.empty(0, t) for t in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hard negatives for each of the five positives of every row of ``embeddings`` whose id 100 divides."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", label, "embedding")
    return mine(vectors, lambda i: i % 100 == 0)


OP11_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
WHERE 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""
