import json

from gristmill.operators.chunking import chunk_documents
from gristmill.sources import corpus


def test_texts_and_cases(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.MD").write_text("first")
    (tmp_path / "b").mkdir()
    (tmp_path / "b/one.txt").write_text("second")
    (tmp_path / "b/two.log").write_text("not this")
    lone = tmp_path / "lone.log"
    lone.write_text("by name")
    rows = corpus.read_texts(spark, str(tmp_path / "a"), str(tmp_path / "b"), str(lone), str(tmp_path / "none")).collect()
    assert {r.doc_id: r.text for r in rows} == {"one": "second", "lone": "by name"}
    cases = tmp_path / "cases.json"
    cases.write_text(json.dumps([{"question": "q", "relevant_docs": ["one"], "expected_route": "retrieve"}, {"question": "r"}]))
    assert [r.question for r in corpus.read_cases(spark, str(cases)).orderBy("query_id").collect()] == ["q", "r"]


def test_chunks_round_trip(spark, tmp_path):
    chunks = chunk_documents(corpus.from_mapping(spark, [("d", "old"), ("d", "a text")])).drop("start", "end")
    assert corpus.write_chunks(chunks, str(tmp_path / "c")) == 1
    assert corpus.read_chunks(spark, str(tmp_path / "c")).collect() == chunks.collect()
    assert corpus.read_chunks(spark, str(tmp_path / "absent")).count() == 0


def test_revisions(spark):
    old = corpus.from_mapping(spark, {"a": "1", "b": "2"})
    new = corpus.from_mapping(spark, {"b": "3", "a": "　 ", "c": "4"})
    assert {r.doc_id: r.text for r in corpus.replace_revisions(old, new).collect()} == {"a": "1", "b": "3", "c": "4"}


def test_patterns_and_missing_paths(spark, tmp_path):
    import pytest

    (tmp_path / "notes [1]").mkdir()
    for name in ("a.md", "b.md", "c.log"):
        (tmp_path / "notes [1]" / name).write_text(name)
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "d.txt").write_text("d")
    with pytest.warns(UserWarning, match="none"):
        rows = corpus.read_texts(spark, f"{tmp_path}/notes*/*.md", f"{tmp_path}/mo*", f"{tmp_path}/none*").collect()
    assert {r.doc_id: r.text for r in rows} == {"a": "a.md", "b": "b.md", "d": "d"}
    with pytest.warns(UserWarning):
        assert corpus.read_texts(spark, f"{tmp_path}/none").count() == 0


def test_helper_columns_never_clash(spark):
    rows = spark.createDataFrame([("k", 1, "x", "y"), ("k", 2, "p", "q")], "doc_id string, revision int, at string, N string")
    assert [tuple(r) for r in corpus.last_of_each(rows, "doc_id").collect()] == [("k", 2, "p", "q")]
