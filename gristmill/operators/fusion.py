"""Rank fusion and rank statistics, query by query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reciprocal_rank_fusion(
    lists: list[tuple[str, DataFrame]], k: int | str = 60, weights: dict[str, float] | None = None, top_k: int | None = None
) -> DataFrame:
    """(query_id, chunk_id, score, ranks, sources, pos): the lists (query_id, chunk_id, rank) fused.

    A hit's score is the sum of weight / (k + rank) over its lists. Equal scores
    go by first appearance: list, then rank. ``k`` may be a column of the lists.
    """
    if isinstance(k, int) and k < 1:
        raise ValueError("k must be at least 1")
    smooth = F.lit(k) if isinstance(k, int) else F.col(k)
    rows = None
    for i, (source, hits) in enumerate(lists):
        weight = float((weights or {}).get(source, 1.0))
        own = hits.select(
            "query_id", "chunk_id", F.col("rank").cast("int").alias("rank"), F.lit(source).alias("source"), F.lit(weight).alias("weight"), F.lit(i).alias("list"), smooth.alias("k")
        )
        rows = own if rows is None else rows.unionByName(own)
    fused = rows.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(F.col("weight") / (F.col("k") + F.col("rank"))), 12).alias("score"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "rank")))).alias("ranks"),
        F.sort_array(F.collect_set("source")).alias("sources"),
        F.min(F.struct("list", "rank")).alias("seen"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "seen", "chunk_id")
    fused = fused.withColumn("pos", F.row_number().over(order)).drop("seen")
    return fused if top_k is None else fused.where(F.col("pos") <= top_k)


def minmax(value: str, by: str = "query_id") -> Column:
    """Scaled to 0..1 within the query; 1 for all where they hardly differ."""
    w = Window.partitionBy(by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high - low < 1e-12, F.lit(1.0)).otherwise((F.col(value) - low) / F.nullif(high - low, F.lit(0.0)))


def spearman(df: DataFrame, a: str, b: str, pos: str = "pos", by: str = "query_id") -> DataFrame:
    """(query_id, n, spearman): correlation of ordinal ranks, ties by position; 0 for one row or a constant side."""
    rank = lambda c: F.row_number().over(Window.partitionBy(by).orderBy(F.desc(c), pos))
    ranked = df.withColumn("ra", rank(a)).withColumn("rb", rank(b))
    stats = ranked.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.corr(F.col("ra").cast("double"), F.col("rb").cast("double")).alias("rho"),
        (F.min(a) == F.max(a)).alias("flat_a"),
        (F.min(b) == F.max(b)).alias("flat_b"),
    )
    none = (F.col("n") < 2) | F.col("flat_a") | F.col("flat_b")
    return stats.select(by, "n", F.when(none, F.lit(0.0)).otherwise(F.coalesce("rho", F.lit(0.0))).alias("spearman"))
