"""Conversation memory: a sliding transcript whose oldest turns are folded into a summary."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dense import memory_units, search

Summariser = Callable[[list[str]], str]


def approx_tokens(text: str) -> int:
    cjk = sum("㐀" <= c <= "鿿" for c in text)
    return cjk + (len(text) - cjk) // 4 + 1


def folded(summary: str, texts: list[str], budget: int) -> str:
    """The summary with ``texts`` after it, of which the last quarter of the budget stays, in characters."""
    keep = max(0, budget // 4)
    return f"{summary} {' '.join(texts)}"[-keep:].strip() if keep else ""


class Transcript:
    """Turns within a budget of approximate tokens; what falls out goes into ``summary``."""

    def __init__(self, budget: int = 1024, summarise: Summariser | None = None):
        self.budget, self.summarise = budget, summarise
        self.turns: list[tuple[str, str, int]] = []
        self.summary, self.evicted, self.held = "", 0, 0

    def tokens(self) -> int:
        return approx_tokens(self.summary) + self.held

    def append(self, role: str, text: str) -> None:
        self.turns.append((role, text, approx_tokens(text)))
        self.held += self.turns[-1][2]
        while self.turns and self.tokens() > self.budget:
            gone, self.turns = self.turns[:2], self.turns[2:]
            self.evicted += len(gone)
            self.held -= sum(n for *_, n in gone)
            texts = [t for _, t, _ in gone]
            self.summary = self.summarise(texts) if self.summarise else folded(self.summary, texts, self.budget)


def compact(conversations: DataFrame, budget: int = 1024, summarise: Summariser | None = None) -> DataFrame:
    """(conv_id, n_turns, kept, evicted, tokens, summary) after all turns (conv_id, turn, role, text) are appended.

    Turns stream in order; what is held of a conversation stays within the budget.
    """
    names = ["conv_id", "n_turns", "kept", "evicted", "tokens", "summary"]
    types = [pa.int64()] * 5 + [pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, memory, n = object(), None, 0
        row = lambda: (now, n, len(memory.turns), memory.evicted, memory.tokens(), memory.summary)
        for batch in batches:
            out = []
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != now:
                    if memory:
                        out.append(row())
                    now, memory, n = conv, Transcript(budget, summarise), 0
                memory.append(role or "", text or "")
                n += 1
            columns = zip(*out, strict=True) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
        if memory:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row(), types, strict=True)], names)

    ordered = conversations.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn").select("conv_id", "role", "text")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, kept long, evicted long, tokens long, summary string")


def context(compacted: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, at, role, text): the summary, if there is one, as a system turn, then the turns that were kept."""
    head = compacted.where("summary <> ''").select(
        "conv_id", F.lit(-1).cast("long").alias("at"), F.lit("system").alias("role"), F.concat(F.lit("Earlier conversation summary: "), "summary").alias("text")
    )
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    kept = turns.withColumn("n", place).join(compacted.select("conv_id", "evicted"), "conv_id").where("n > evicted")
    return head.unionByName(kept.select("conv_id", F.col("turn").cast("long").alias("at"), "role", "text"))


def recall(items: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, chunk_id, score, rank): remembered texts (key, text) nearest to each query (query_id, text) by cosine."""
    return search(memory_units(items, "key").withColumnRenamed("key", "chunk_id"), memory_units(queries, "query_id"), k)
