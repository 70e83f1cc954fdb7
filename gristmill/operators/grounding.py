"""Grounding: does the evidence hold what an answer claims?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_tokens, is_claim, normalise_ws, overlap_coefficient, sentences, strip_citations


def verify(answers: DataFrame, evidence: DataFrame, floor: float = 0.18) -> DataFrame:
    """(query_id, support_rate, checked, supported, unsupported) of each answer (query_id, text).

    ``evidence``: query_id, text. A claim is supported where a sentence of the
    evidence holds ``floor`` of its distinct content tokens, or where it has under two
    content tokens. Without claims the rate is 1.
    """
    clean = normalise_ws(strip_citations(F.col("text")))
    claims = answers.select("query_id", F.posexplode(F.filter(sentences(clean), is_claim)).alias("at", "claim"))
    claims = claims.select("query_id", "at", "claim", content_tokens("claim").alias("tokens"))
    flat = sentences(normalise_ws("text"))
    flat = F.when(F.size(flat) > 0, flat).otherwise(F.array("text"))
    known = evidence.select("query_id", F.explode(flat).alias("s")).select("query_id", content_tokens("s").alias("known")).where(F.size("known") > 0)
    best = claims.where(F.size("tokens") >= 2).join(known, "query_id")
    best = best.groupBy("query_id", "at").agg(F.max(overlap_coefficient(F.col("tokens"), F.col("known"))).alias("best"))
    judged = claims.join(best, ["query_id", "at"], "left")
    ok = (F.size("tokens") < 2) | (F.coalesce("best", F.lit(0.0)) >= floor)
    judged = judged.withColumn("ok", ok).groupBy("query_id").agg(
        F.count(F.lit(1)).cast("int").alias("checked"),
        F.count_if("ok").cast("int").alias("supported"),
        F.array_sort(F.collect_list(F.when(~F.col("ok"), F.struct("at", "claim")))).alias("bad"),
    )
    rows = answers.select("query_id").join(judged, "query_id", "left")
    return rows.select(
        "query_id",
        F.coalesce(F.col("supported") / F.col("checked"), F.lit(1.0)).alias("support_rate"),
        F.coalesce("checked", F.lit(0)).alias("checked"),
        F.coalesce("supported", F.lit(0)).alias("supported"),
        F.coalesce(F.transform("bad", lambda b: b["claim"]), F.array().cast("array<string>")).alias("unsupported"),
    )
