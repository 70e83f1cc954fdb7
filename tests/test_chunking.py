import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from gristmill.operators import chunking

TEXTS = st.text(st.sampled_from("ab 。!?\n#x中;"), max_size=400)


@given(TEXTS, st.integers(1, 60), st.integers(0, 30))
@settings(max_examples=200, deadline=None)
def test_base_spans_cover_the_text(text, size, overlap):
    if not text:
        return
    spans = chunking.base_spans(text, size, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert "".join(text[s:e] for s, e in spans) == text
    chunks = list(chunking.chunk(text, size, overlap))
    assert [c[0] for c in chunks] == list(range(len(chunks)))


def test_known_spans():
    text = "x" * 670 + "。\n\n# " + "h" * 50 + "\n\nnext paragraph is here。"
    assert [e - s for s, e in chunking.base_spans(text, 800, 120)] == [727, 23]
    assert list(chunking.chunk("")) == []
    assert len(list(chunking.chunk("只有一句话。"))) == 1
    assert [b[0] for b in chunking.blocks("# One\na\n\nb\n## Two\nc")] == ["One", "One", "Two"]


def test_sql_function_and_table(spark):
    chunking.register(spark)
    text = "# Title\n" + "A sentence here! " * 100
    docs = spark.createDataFrame([("d", text), ("e", None)], "doc_id string, text string")
    docs.createOrReplaceTempView("docs_to_cut")
    rows = spark.sql("SELECT doc_id, s.* FROM docs_to_cut, LATERAL chunk_spans(text, 300, 50) s").collect()
    table = chunking.chunk_documents(docs, 300, 50).collect()
    assert [(r.ordinal, r.start, r.end, r.heading, r.text) for r in rows] == [(r.ordinal, r.start, r.end, r.heading, r.text) for r in table]
    assert {r.heading for r in table} == {"Title"} and table[1].chunk_id == "d#1"


def test_stretches_are_small_and_whole():
    """What is made of a batch leaves in stretches of bounded bytes, a longer text alone."""
    texts = ["x" * 300, None, "", "y" * 900, "é" * 100, "z" * 10] * 5
    batch = pa.RecordBatch.from_arrays([pa.array(map(str, range(30))), pa.array(texts)], ["doc_id", "text"]).slice(1)
    parts = list(chunking.stretches(batch, 500))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch])) and len(parts) > 5
    for part in parts:
        assert part.num_rows == 1 or sum(len((t or "").encode()) for t in part.column(1).to_pylist()) <= 500
