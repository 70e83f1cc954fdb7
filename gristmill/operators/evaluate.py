"""Retrieval metrics, counters and latencies as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranking_metrics(retrieved: DataFrame, relevant: DataFrame, queries: DataFrame, k: int = 6) -> DataFrame:
    """Per query: recall, precision, reciprocal rank (of the whole list) and nDCG at ``k``.

    ``retrieved``: query_id, id, rank; ``relevant``: query_id, id; ``queries``:
    query_id. Nothing relevant: recall 1 and nDCG 0. Nothing retrieved: precision 0.
    """
    truth = relevant.select("query_id", "id").distinct().withColumn("hit", F.lit(1))
    sizes = truth.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rel"))
    rows = retrieved.join(truth, ["query_id", "id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    top = F.col("rank") <= k
    stats = rows.groupBy("query_id").agg(
        F.count_distinct(F.when(top & (F.col("hit") == 1), F.col("id"))).alias("hits"),
        F.count_if(top).alias("n_top"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(top & (F.col("hit") == 1), 1 / F.log2(F.col("rank") + 1.0))).alias("dcg"),
    )
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.col("n_rel").cast("int")))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0)
    )
    rows = queries.select("query_id").join(sizes, "query_id", "left").join(stats, "query_id", "left")
    zero = F.lit(0.0)
    return rows.select(
        "query_id",
        F.when(F.col("n_rel").isNull(), F.lit(1.0)).otherwise(F.coalesce(F.col("hits") / F.col("n_rel"), zero)).alias("recall"),
        F.coalesce(F.col("hits") / F.nullif(F.col("n_top"), F.lit(0)), zero).alias("precision"),
        F.coalesce(1 / F.col("first"), zero).alias("reciprocal_rank"),
        F.coalesce(F.when(F.col("n_rel").isNotNull(), F.col("dcg") / ideal), zero).alias("ndcg"),
    )


def document_metrics(retrieved: DataFrame, relevant_docs: DataFrame, queries: DataFrame, k: int = 6) -> DataFrame:
    """Per query: whether a relevant document is among the first ``k`` (doc_hit) and the reciprocal of its rank (doc_rr)."""
    truth = relevant_docs.select("query_id", "doc_id").distinct()
    first = retrieved.where(F.col("rank") <= k).join(truth, ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    rows = queries.select("query_id").join(first, "query_id", "left")
    return rows.select(
        "query_id",
        F.when(F.col("first").isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0)).alias("doc_hit"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("doc_rr"),
    )


def report(per_case: DataFrame) -> DataFrame:
    """One row of means. ``per_case``: has_docs, recall, precision, reciprocal_rank, ndcg, doc_hit, doc_rr, grounded, expected_route, route, latency_ms.

    Retrieval means are over the cases that have relevant documents; route
    accuracy over those that expect a route (1 if none does).
    """
    mean = lambda c: F.coalesce(F.round(F.avg(F.when(F.col("has_docs"), F.col(c))), 6), F.lit(0.0))
    right = F.when(F.col("expected_route").isNotNull(), (F.col("route") == F.col("expected_route")).cast("double"))
    return per_case.agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if("has_docs").alias("retrieval_cases"),
        mean("recall").alias("recall"),
        mean("precision").alias("precision"),
        mean("reciprocal_rank").alias("mrr"),
        mean("ndcg").alias("ndcg"),
        mean("doc_hit").alias("doc_hit_rate"),
        mean("doc_rr").alias("doc_mrr"),
        F.coalesce(F.round(F.avg("grounded"), 6), F.lit(0.0)).alias("grounding_rate"),
        F.coalesce(F.round(F.avg(right), 6), F.lit(1.0)).alias("route_accuracy"),
        F.round(F.percentile("latency_ms", F.lit(0.5)), 3).alias("latency_p50"),
        F.round(F.percentile("latency_ms", F.lit(0.95)), 3).alias("latency_p95"),
    )


def deterministic_view(reports: DataFrame) -> DataFrame:
    """``reports`` without what differs from run to run: the latencies."""
    return reports.drop("latency_p50", "latency_p95", "latency_ms")


def latency_summary(samples: DataFrame, last: int = 512) -> DataFrame:
    """(key, n, mean, p50, p95, max) of the ``last`` samples (key, seq, ms) of each key."""
    order = Window.partitionBy("key").orderBy(F.desc("seq"))
    recent = samples.withColumn("n", F.row_number().over(order)).where(F.col("n") <= last)
    return recent.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("ms").alias("mean"),
        F.percentile("ms", F.lit(0.5)).alias("p50"),
        F.percentile("ms", F.lit(0.95)).alias("p95"),
        F.max("ms").alias("max"),
    )


def counters(events: DataFrame) -> DataFrame:
    """(key, value): sums of (key, value) rows."""
    return events.groupBy("key").agg(F.sum("value").alias("value"))
