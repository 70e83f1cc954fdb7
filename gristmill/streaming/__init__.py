"""Structured Streaming: continuous ingest and keyed conversation memory."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.memory import Transcript, approx_tokens, folded
from ..plans.engine import Engine


def continuous_ingest(docs: DataFrame, engine: Engine, checkpoint: str, **trigger) -> StreamingQuery:
    """Each micro-batch of a stream (doc_id, text) goes into the engine, newer revisions in the place of older ones."""

    def take(batch: DataFrame, _: int) -> None:
        engine.ingest(batch)

    return docs.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def conversation_memory(turns: DataFrame, budget: int = 1024) -> DataFrame:
    """(conv_id, kept, evicted, tokens, summary) after each micro-batch of a stream (conv_id, turn, role, text)."""
    state_schema = "roles array<string>, texts array<string>, summary string, evicted long"
    out_schema = "conv_id long, kept long, evicted long, tokens long, summary string"

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory = Transcript(budget)
        if state.exists:
            roles, texts, memory.summary, evicted = state.get
            for role, text in zip(roles, texts, strict=True):
                memory.append(role, text)
            memory.evicted = evicted
        # A group comes in several frames, in no order; its turns of this micro-batch are put in order as a whole.
        for row in pd.concat([*frames]).sort_values("turn", kind="stable").itertuples():
            memory.append(row.role or "", row.text or "")
        roles, texts = [r for r, _, _ in memory.turns], [t for _, t, _ in memory.turns]
        state.update((roles, texts, memory.summary, memory.evicted))
        yield pd.DataFrame(
            [(key[0], len(roles), memory.evicted, memory.tokens(), memory.summary)], columns=["conv_id", "kept", "evicted", "tokens", "summary"]
        )

    return turns.groupBy("conv_id").applyInPandasWithState(update, out_schema, state_schema, "update", GroupStateTimeout.NoTimeout)


class KeptTurns(StatefulProcessor):
    """A conversation as state: a map of the turns within the budget, and a value with the summary of what fell out.

    A batch writes its own turns and removes those that fall out, whatever else is kept.
    Turns of one batch are put in order; one that comes in a later batch than turns after
    it counts as said when it came. A conversation that is idle for ``idle_ms`` (if
    given) gives a last row, ``closed``, and is forgotten.
    """

    def __init__(self, budget: int, idle_ms: int | None):
        self.budget, self.idle_ms = budget, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getMapState("turns", "place long", "text string, tokens long")
        self.rest = handle.getValueState("rest", "first long, next long, held long, summary string, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first, after, held, summary, timer = self.rest.get() if self.rest.exists() else (0, 0, 0, "", 0)
        for row in pd.concat([*rows]).sort_values("turn", kind="stable").itertuples():
            text = row.text or ""
            size = approx_tokens(text)
            self.turns.updateValue((after,), (text, size))
            after, held = after + 1, held + size
            while first < after and approx_tokens(summary) + held > self.budget:
                gone = [self.turns.getValue((i,)) for i in range(first, min(first + 2, after))]
                for i in range(first, first + len(gone)):
                    self.turns.removeKey((i,))
                first, held = first + len(gone), held - sum(n for _, n in gone)
                summary = folded(summary, [t for t, _ in gone], self.budget)
        if self.idle_ms:
            if timer:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(timer)
        self.rest.update((first, after, held, summary, timer))
        yield self._row(key, first, after, held, summary, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first, after, held, summary, _ = self.rest.get()
        self.turns.clear()
        self.rest.clear()
        yield self._row(key, first, after, held, summary, True)

    def _row(self, key, first: int, after: int, held: int, summary: str, closed: bool) -> pd.DataFrame:
        row = (key[0], after, after - first, first, approx_tokens(summary) + held, summary, closed)
        return pd.DataFrame([row], columns=["conv_id", "n_turns", "kept", "evicted", "tokens", "summary", "closed"])

    def close(self) -> None:
        pass


def conversation_state(turns: DataFrame, budget: int = 1024, idle_ms: int | None = None) -> DataFrame:
    """(conv_id, n_turns, kept, evicted, tokens, summary, closed) after each micro-batch of a stream (conv_id, turn, role, text).

    Needs the RocksDB state store (``STATE_STORE``).
    """
    out = "conv_id long, n_turns long, kept long, evicted long, tokens long, summary string, closed boolean"
    mode = "ProcessingTime" if idle_ms else "None"
    return turns.groupBy("conv_id").transformWithStateInPandas(KeptTurns(budget, idle_ms), out, "Update", mode)


STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def windowed_latencies(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(window, key, n, total) of timed events (ts, key, ms), closed once the watermark has passed."""
    by = [F.window("ts", width), "key"]
    return events.withWatermark("ts", late).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("ms").alias("total"))
