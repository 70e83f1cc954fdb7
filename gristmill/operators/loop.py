"""The bounded loop of reading and tools, as a frontier of questions.

A question's state (step, scratchpad, trace) is a row. A round lets the reader speak on
all open questions at once: those with a final answer, or with an output that is
neither answer nor action, leave the frontier; the others' tools run, and what they
return is added to the scratchpad. It ends when the frontier is empty or the budget
of steps is spent, so a round costs what its open questions cost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import BUDGET_NOTE, ERROR_MARK, STEP_NOTE, UNPARSABLE_NOTE
from .reader import parse_action, parse_final

#: Open questions (query_id, text, step, scratchpad) to what the reader says of each: (query_id, output).
Completer = Callable[[DataFrame], DataFrame]
#: Calls (query_id, tool, payload) to (query_id, ok, value, error).
Invoker = Callable[[DataFrame], DataFrame]


def run_loop(questions: DataFrame, complete: Completer, invoke: Invoker, max_steps: int, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(query_id, final, steps, trace, scratchpad): ``questions`` (query_id, text) after at most ``max_steps`` rounds.

    ``final`` is null for outputs that can't be read and for questions whose budget is
    spent; ``trace`` says so. A question of which the reader says nothing counts as the
    former, a call that returns nothing as an error. ``cut`` writes a step down.
    """
    none = F.array().cast("array<string>")
    frontier = cut(questions.select("query_id", "text", F.lit("").alias("scratchpad"), none.alias("trace")))
    finished, names = None, ["query_id", "final", "steps", "trace", "scratchpad"]
    for step in range(1, max(1, max_steps) + 1):
        output = F.coalesce("output", F.lit(""))
        said = frontier.join(complete(frontier.withColumn("step", F.lit(step))), "query_id", "left").withColumn("output", output)
        said = cut(said.withColumns({"final": parse_final(F.col("output")), "action": parse_action(F.col("output"))}))
        over = F.col("final").isNotNull() | F.col("action").isNull()
        note = F.when(F.col("final").isNull(), F.lit(UNPARSABLE_NOTE.format(step)))
        done = said.where(over).select("query_id", "final", F.lit(step).alias("steps"), F.array_compact(F.concat("trace", F.array(note))).alias("trace"), "scratchpad")
        finished = done if finished is None else finished.unionByName(done)
        frontier = said.where(~over)
        if frontier.limit(1).count() == 0:
            break
        seen = invoke(frontier.select("query_id", "action.tool", "action.payload"))
        rows = frontier.join(seen.select("query_id", F.struct("ok", "value", "error").alias("result")), "query_id", "left")
        error = F.concat(F.lit(ERROR_MARK), F.coalesce("result.error", F.concat(F.lit("unknown tool: "), "action.tool")))
        rows = rows.withColumn("observation", F.when(F.col("result.ok"), F.col("result.value")).otherwise(error))
        call = F.concat("action.tool", F.lit("["), "action.payload", F.lit("]"))
        thought = F.trim(F.regexp_extract("output", r"^[^\r\n]*", 0))
        more = F.concat(F.lit("Thought: "), thought, F.lit("\nAction: "), call, F.lit("\nObservation: "), "observation", F.lit("\n"))
        line = F.concat(F.lit(STEP_NOTE.format(step)), call, F.lit(" -> "), F.left("observation", F.lit(120)))
        frontier = cut(rows.select("query_id", "text", F.concat("scratchpad", more).alias("scratchpad"), F.concat("trace", F.array(line)).alias("trace")))
    else:
        spent = F.array(F.lit(BUDGET_NOTE.format(max_steps)))
        left = frontier.select("query_id", F.lit(None).cast("string").alias("final"), F.lit(max_steps).alias("steps"), F.concat("trace", spent).alias("trace"), "scratchpad")
        finished = finished.unionByName(left)
    return finished.select(*names)
