"""Many settings of a search at once: settings are rows, the postings of the questions are read once for all of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import evaluate, fusion, sparse

SETTING = "setting string, k1 double, b double, rrf_k int"


def named(rows: DataFrame, settings: DataFrame, *columns: str) -> DataFrame:
    """``rows`` (query_id, ...) once for each setting, which goes before the query_id."""
    # The caller's list of settings: a few rows.
    met = rows.crossJoin(F.broadcast(settings.select("setting", *columns)))
    return met.withColumn("query_id", F.concat_ws("\u0001", "setting", "query_id")).drop("setting")


def search(postings: DataFrame, stats: DataFrame, terms: DataFrame, settings: DataFrame, k: int, digits: int = 12) -> DataFrame:
    """(query_id, chunk_id, score, rank) of the ``k`` best by BM25 under each setting, with which ``query_id`` begins.

    ``postings``: of the terms in ``terms`` (query_id, term, qtf), or of all, in either form that ``sparse.best_of`` reads.
    No pair of question and chunk is shuffled, under any setting.
    """
    each = {r.setting: (r.k1, r.b) for r in settings.collect()}  # the caller's list: a few rows
    if "terms" not in postings.columns:
        postings = postings.join(terms.select("term").distinct(), "term", "left_semi")
    return sparse.best_of(postings, stats, terms, k, digits=digits, settings=each)


def metrics(
    postings: DataFrame, stats: DataFrame, queries: DataFrame, relevant: DataFrame, settings: DataFrame, others: list[tuple[str, DataFrame]] = (),
    k: int = 6, digits: int = 12, cut: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """(setting, recall, precision, mrr, ndcg): means over ``queries`` (query_id, text), a row for each of ``settings`` (see SETTING).

    ``relevant``: query_id, id. BM25 alone, or fused by reciprocal ranks with ``others``
    (name, (query_id, chunk_id, rank)), which come before it.
    """
    found = cut(search(postings, stats, sparse.query_terms(queries), settings, k, digits))
    asked = queries.select("query_id")
    if others:
        smoothing = named(asked, settings, "rrf_k")
        lists = [(name, named(rows.select("query_id", "chunk_id", "rank"), settings)) for name, rows in others] + [("sparse", found)]
        fused = fusion.reciprocal_rank_fusion([(name, rows.join(smoothing, "query_id")) for name, rows in lists], "rrf_k", top_k=k)
        found = cut(fused).withColumn("rank", F.col("pos"))
    hits = found.select("query_id", F.col("chunk_id").alias("id"), "rank")
    per = evaluate.ranking_metrics(hits, named(relevant, settings), named(asked, settings), k)
    mean = lambda c: F.round(F.avg(c), 6)
    setting = F.element_at(F.split("query_id", "\u0001"), 1).alias("setting")
    return per.groupBy(setting).agg(mean("recall").alias("recall"), mean("precision").alias("precision"), mean("reciprocal_rank").alias("mrr"), mean("ndcg").alias("ndcg"))
