"""The extractive reader: the evidence sentence nearest to the question, with its citation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import NO_ANSWER
from ..functions.text import content_tokens, normalise_ws, sentences, strip


def sentence_score(question: Column, sentence: Column) -> Column:
    """Cosine of two token sets (arrays of distinct tokens)."""
    size = F.size(question) * F.size(sentence)
    return F.coalesce(F.size(F.array_intersect(question, sentence)) / F.sqrt(F.nullif(size, F.lit(0))), F.lit(0.0))


def best_sentences(questions: DataFrame, pool: DataFrame) -> DataFrame:
    """(query_id, score, sentence, chunk_id): of each query's ``pool`` (query_id, place, chunk_id, text) the best sentence.

    Sentences under eight characters and headings don't count; of equals the first
    in the pool wins; queries for which nothing scores have no row.
    """
    q = questions.select("query_id", F.array_distinct(content_tokens("text")).alias("q"))
    parts = sentences(normalise_ws("text"))
    parts = F.when(F.size(parts) > 0, parts).otherwise(F.array(normalise_ws("text")))
    rows = pool.select("query_id", "place", "chunk_id", F.posexplode(parts).alias("at", "sentence"))
    rows = rows.where((F.length("sentence") >= 8) & ~F.col("sentence").startswith("#"))
    rows = rows.join(q, "query_id").withColumn("score", F.round(sentence_score(F.col("q"), F.array_distinct(content_tokens("sentence"))), 12))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "place", "at")
    best = rows.where("score > 0").withColumn("n", F.row_number().over(order)).where("n = 1")
    return best.select("query_id", "score", "sentence", "chunk_id")


def answer_text(sentence: Column, chunk_id: Column) -> Column:
    return F.when(sentence.isNull(), F.lit(NO_ANSWER)).otherwise(F.concat(sentence, F.lit(" (依据："), chunk_id, F.lit(")")))


def fallback(chunk_id: Column, text: Column) -> Column:
    """The first piece of evidence, 200 characters of it; without any, that there is none."""
    head = F.left(F.replace(strip(text), F.lit("\n"), F.lit(" ")), F.lit(200))
    return F.when(text.isNull(), F.lit(NO_ANSWER)).otherwise(F.concat(F.lit("根据已有资料，最相关的依据是 ["), chunk_id, F.lit("]："), head))


def render_evidence(hits: DataFrame) -> DataFrame:
    """(query_id, block): the chunks of each query (query_id, rank, chunk_id, text), one flattened line each."""
    line = F.concat(F.lit("["), F.col("chunk_id"), F.lit("] "), normalise_ws("text"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda r: r["line"])
    block = F.concat_ws("\n", F.concat(F.array(F.lit("<kb-context>")), lines, F.array(F.lit("</kb-context>"))))
    return hits.groupBy("query_id").agg(block.alias("block"))


def build_prompt(question: Column, block: Column, steps: Column | None = None) -> Column:
    empty = F.lit("<kb-context>\n(no evidence retrieved)\n</kb-context>")
    parts = [F.concat(F.lit("Question: "), question), F.lit(""), F.coalesce(block, empty)]
    if steps is not None:
        parts.append(F.when(steps != "", F.concat(F.lit("\nPrevious steps:\n"), steps)))
    parts += [F.lit(""), F.lit("Reply with either one Action line or one Final Answer line.")]
    return F.concat_ws("\n", *parts)


_ACTION = r"(?i)^\s*action:\s*([^\[\n]*)\[(.*)\]\s*$"


def parse_action(text: Column) -> Column:
    """(tool, payload) of the first ``Action: tool[payload]`` line; null without one."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(_ACTION))
    first = F.get(lines, 0)
    made = F.struct(F.trim(F.regexp_extract(first, _ACTION, 1)).alias("tool"), F.trim(F.regexp_extract(first, _ACTION, 2)).alias("payload"))
    return F.when(first.isNotNull(), made)


def parse_final(text: Column) -> Column:
    """What follows the first ``Final Answer:`` with the lines after it; else a single line that is no directive; else null."""
    lines = F.split(text, "\n")
    at = F.array_position(F.transform(lines, lambda x: x.rlike(r"(?i)^\s*final answer:")), True).cast("int")
    first = F.trim(F.regexp_replace(F.get(lines, at - 1), r"(?i)^\s*final answer:", ""))
    tail = F.filter(F.transform(F.slice(lines, at + 1, F.size(lines)), strip), lambda x: x != "")
    plain = (F.size(lines) == 1) & (strip(text) != "") & ~text.rlike(r"(?i)^\s*(action|thought|observation):")
    return F.when(at > 0, strip(F.concat_ws("\n", F.concat(F.array(first), tail)))).when(plain, strip(text))


def observations(text: Column) -> Column:
    """(chunk_id, excerpt) pairs of ``[id] excerpt | [id] excerpt``."""
    pattern = r"\[([^\]]+)\]\s*([^|]+)"
    pairs = F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda m: F.struct(F.trim(F.regexp_extract(m, pattern, 1)).alias("chunk_id"), F.trim(F.regexp_extract(m, pattern, 2)).alias("excerpt")),
    )
    return F.filter(pairs, lambda p: p["excerpt"] != "")
