"""Reranking under a guard: a reranker that contradicts the fused order loses its say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize
from .fusion import minmax, spearman

#: (query_id, pos, text) candidates to (query_id, pos, rerank_score).
Reranker = Callable[[DataFrame, DataFrame], DataFrame]


def lexical_rerank(queries: DataFrame, candidates: DataFrame, cut: int = 10) -> DataFrame:
    """(query_id, pos, rerank_score) of the ``cut`` best: idf over the candidates, damped tf, over the root of length."""
    tokens = candidates.select("query_id", "pos", tokenize("text").alias("tokens"))
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    tokens = tokens.select("query_id", "pos", "tokens", n.alias("n"), F.greatest(F.lit(1), F.size("tokens")).alias("dl"))
    q = queries.select("query_id", F.explode(F.array_distinct(tokenize("text"))).alias("term"))
    terms = tokens.select("query_id", "pos", "n", "dl", F.explode("tokens").alias("term")).join(q, ["query_id", "term"])
    tf = terms.groupBy("query_id", "term", "pos", "n", "dl").agg(F.count(F.lit(1)).alias("tf"))
    df = F.count(F.lit(1)).over(Window.partitionBy("query_id", "term"))
    gain = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * (1 + F.log("tf")) / F.sqrt("dl")
    scored = tf.withColumn("df", df).groupBy("query_id", "pos").agg(F.sum(gain).alias("s"))
    scored = tokens.join(scored, ["query_id", "pos"], "left").select("query_id", "pos", F.round(F.coalesce("s", F.lit(0.0)), 12).alias("rerank_score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "pos")
    return scored.withColumn("r", F.row_number().over(order)).where(F.col("r") <= cut).drop("r")


def guarded_rerank(
    fused: DataFrame, scores: DataFrame | None, alpha: float = 0.5, floor: float = 0.2, enabled: bool = True
) -> DataFrame:
    """``fused`` (query_id, chunk_id, score, ranks, sources, pos) blended with ``scores`` (query_id, pos, rerank_score).

    Adds spearman, alpha_eff, applied, reason and final_pos. Hits without a score
    have 0. Below zero correlation alpha is 0, below ``floor`` half of it.
    """
    none = scores is None or not enabled
    if none:
        reason = "guard disabled by config" if not enabled else "reranker returned no scores"
        extra = {"spearman": F.lit(0.0), "alpha_eff": F.lit(0.0), "applied": F.lit(False), "reason": F.lit(reason), "final_pos": F.col("pos")}
        return fused.withColumns(extra)
    rows = fused.join(scores, ["query_id", "pos"], "left").withColumn("rerank_score", F.coalesce("rerank_score", F.lit(0.0)))
    rho = spearman(rows, "score", "rerank_score").select("query_id", F.round("spearman", 12).alias("spearman"))
    alpha_eff = F.when(F.col("spearman") < 0, F.lit(0.0)).when(F.col("spearman") < floor, F.lit(alpha / 2)).otherwise(F.lit(alpha))
    text = F.format_string("%.3f", "spearman")
    reason = (
        F.when(F.col("spearman") < 0, F.concat(F.lit("reranker anti-correlated (rho="), text, F.lit("); ignored")))
        .when(F.col("spearman") < floor, F.concat(F.lit("weak agreement (rho="), text, F.lit(f" < {floor}); alpha halved")))
        .otherwise(F.concat(F.lit("reranker agrees with retriever (rho="), text, F.lit("); blended")))
    )
    rows = rows.join(rho, "query_id").withColumns({"alpha_eff": alpha_eff, "reason": reason})
    rows = rows.withColumns({"norm_f": minmax("score"), "norm_r": minmax("rerank_score")})
    blended = F.round((1 - F.col("alpha_eff")) * F.col("norm_f") + F.col("alpha_eff") * F.col("norm_r"), 12)
    order = Window.partitionBy("query_id").orderBy(F.desc("blended"), "pos")
    rows = rows.withColumn("blended", blended).withColumn("final_pos", F.row_number().over(order))
    return rows.select(
        "query_id",
        "chunk_id",
        F.col("blended").alias("score"),
        F.map_concat("ranks", F.create_map(F.lit("blend"), F.col("final_pos"))).alias("ranks"),
        F.sort_array(F.array_union("sources", F.array(F.lit("rerank")))).alias("sources"),
        "pos",
        "spearman",
        "alpha_eff",
        (F.col("alpha_eff") > 0).alias("applied"),
        "reason",
        "final_pos",
    )


def naive_rerank(fused: DataFrame, scores: DataFrame) -> DataFrame:
    """The order that the reranker alone would give: query_id, chunk_id, score, pos, final_pos."""
    rows = fused.join(scores, ["query_id", "pos"], "left").withColumn("rerank_score", F.coalesce("rerank_score", F.lit(0.0)))
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "pos")
    return rows.select("query_id", "chunk_id", F.col("rerank_score").alias("score"), "pos", F.row_number().over(order).alias("final_pos"))
