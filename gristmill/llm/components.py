"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, tidy


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch's edges, a star for each of its components: fewer edges, the same connections."""
    for batch in batches:
        a, b = (batch.column(i).to_numpy() for i in (0, 1))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        parent = np.arange(len(nodes))
        a, b = at[: len(a)], at[len(a) :]
        while True:  # hook the larger root to the smaller, then shorten all paths
            ra, rb = parent[a], parent[b]
            low, high = np.minimum(ra, rb), np.maximum(ra, rb)
            if (low == high).all():
                break
            np.minimum.at(parent, high, low)
            while not np.array_equal(up := parent[parent], parent):
                parent = up
        off = parent != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[off]), pa.array(nodes[parent[off]])], ["u", "v"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u > v). Large: larger neighbours of u go to u's least neighbour. Small: the smaller ones do."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u")
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            joined.select("u", F.col("m").alias("v"))
        )
    return moved.where("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges`` (two long columns) to a scratch table (node, component): each node's least reachable node.

    Nodes that are their own component's least one have no row. Loops and
    repeated edges do no harm; nulls are dropped; no edges give no rows.
    """
    a, b = edges.columns
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    now = scratch.write(pairs.mapInArrow(tidy(_local), "u long, v long").distinct())
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == before:
            break
        before = mark
        new = scratch.write(_star(_star(now, True), False))
        scratch.drop(now)
        now = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
