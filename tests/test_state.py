"""Conversations as keyed streaming state: in order, out of order, and idle."""

import pytest

from gristmill.operators.memory import compact
from gristmill.streaming import STATE_STORE, conversation_state

TURNS = "conv_id long, turn long, role string, text string"


@pytest.fixture
def streamed(spark, tmp_path):
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)

    def run(batches, **how):
        for i, rows in enumerate(batches):
            path = tmp_path / f"in{i}"
            spark.createDataFrame(rows, TURNS).coalesce(1).write.parquet(str(path))
            (file,) = path.glob("part-*.parquet")
            (tmp_path / "all").mkdir(exist_ok=True)
            file.rename(tmp_path / "all" / f"{i}.parquet")
        source = spark.readStream.schema(TURNS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "all"))
        seen = []
        stream = conversation_state(source, **how).writeStream.foreachBatch(lambda rows, n: seen.extend((n, r) for r in rows.collect()))
        stream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(180)
        return seen

    yield run
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_batches_in_order_give_what_one_table_gives(spark, streamed):
    rows = [(c, i, "user", f"turn {i} of {c} " + "word " * (i % 5)) for c in (1, 2) for i in range(30)] + [(2, 30, "user", None)]
    seen = streamed([[r for r in rows if r[1] % 10 < 5 and r[1] < 15 or r[1] < 10], [r for r in rows if 10 <= r[1] < 20 and not r[1] < 15], [r for r in rows if r[1] >= 20]], budget=60)
    last = {r.conv_id: r for _, r in seen}
    want = {r.conv_id: r for r in compact(spark.createDataFrame(rows, TURNS), 60).collect()}
    for c in (1, 2):
        assert all(last[c][f] == want[c][f] for f in ("n_turns", "kept", "evicted", "tokens", "summary"))


def test_late_turns_count_when_they_come(spark, streamed):
    seen = streamed([[(1, 2, "user", "second")], [(1, 1, "user", "first")]], budget=4)
    assert [(r.n_turns, r.kept, r.summary) for _, r in seen] == [(1, 1, ""), (2, 0, "t")]
    plain = compact(spark.createDataFrame([(1, 1, "user", "second"), (1, 2, "user", "first")], TURNS), 4).first()
    assert (plain.kept, plain.summary) == (0, "t")


def test_idle_conversations_are_closed(streamed):
    seen = streamed([[(1, 1, "user", "hello there")], [(2, 1, "user", "x")], [(2, 2, "user", "y")], [(1, 2, "user", "again")]], budget=60, idle_ms=1)
    closed = [r for _, r in seen if r.closed and r.conv_id == 1]
    assert closed and closed[0].n_turns == 1
    assert [r.n_turns for _, r in seen if r.conv_id == 1 and not r.closed] == [1, 1]  # begun anew


