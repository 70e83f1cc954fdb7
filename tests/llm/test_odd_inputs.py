"""Long texts, letters, marks and other inputs that once gave wrong results."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gristmill.llm import chat_format, language_id, packing, secrets

DOCS = "doc_id long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def encode():
    with open(packing.TOKENIZER, "rb") as f:
        return packing._encoder(f.read())


def test_blank_runs_are_cut_where_the_pattern_cuts(encode):
    import base64

    import tiktoken

    with open(packing.TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
    plain = tiktoken.Encoding("own", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    rng = random.Random(1)
    for _ in range(40):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts.append("".join(rng.choice(" \n\t\u3000\x85") for _ in range(rng.choice((1, 3, 4095, 4096, 6000)))))
            parts.append(rng.choice(("word", "it's", "12", "?!", "\x1c", "", "x" * 5000, "\u00e9")))
        text = "".join(parts[rng.randrange(2) :])
        assert encode(text) == plain(text)


def test_very_long_texts_are_packed(spark):
    texts = ["\n" * 1_000_000, " " * 1_000_000 + "x", "y" * 300_000, "a b " * 100_000, "?" * 300_000, "\n \n" * 300_000 + "end"]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    out = packing.pack_documents(df).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    counted = {r.doc_id: r.n_tokens for r in packing.count_tokens(df).collect()}
    assert {r.doc_id: r.n for r in out} == counted and all(n > 1 for n in counted.values())


def test_numbers_are_no_letters(spark):
    rows = [(1, "\u00bd \u00b2 12", None), (2, "\u2167 \u3021", None), (3, "the cat", None), (4, "the dog", "en"), (5, "\u00bd a", None)]
    df = spark.createDataFrame(rows, DOCS + ", lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.predict(df, language_id.fit(df)).collect()}
    assert got == {1: "und", 2: "und", 3: "en", 4: "en", 5: "en"}


def test_sample_is_bounded_by_rows_not_by_ids(spark):
    rows = [(None, f"text number {i} of many", "en") for i in range(900)] + [(7, "same text", "de")] * 500
    df = spark.createDataFrame(rows, DOCS + ", lang string").select("lang", "text", language_id.doc_key().alias("doc"))
    sample = language_id._sample(df, 300, 400)
    assert len(sample) == 301 and sum(lang == "de" for _, lang in sample) == 1
    assert len(language_id._sample(df, 300, 100)) == 100


def test_mark_in_texts(spark):
    odd = "x\ue000\uf8ff\ue001 \ue0000\ue001\ue0001\ue001"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", "hello"), (1, 2, odd, "h"), (1, 3, "assistant", odd)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (r,) = chat_format.digests(chat_format.format_turns(df)).collect()
    assert r.loss_chars == 5 + len(odd) and r.loss_sha256 == sha("hello" + odd)


@pytest.mark.parametrize("template", [chat_format.chatml, None])
def test_more_turns_than_the_context(spark, template):
    def first_turn_again(messages):  # from the 600th turn on the first one changes
        return "".join(f"[{m['content'] if i or len(messages) < 600 else '-'}]" for i, m in enumerate(messages))

    turns = [{"role": ("user", "assistant")[i % 2], "content": f"t{i}"} for i in range(1100)]
    out, spans = "", []
    use = template or first_turn_again
    for piece, back, a, b in chat_format.spans(iter(turns), use, 64 if template else None):
        out = out[: len(out) - back] + piece
        spans.append(out[len(out) - len(piece) + a : len(out) - len(piece) + b])
    assert out == use(turns)
    assert [s for i, s in enumerate(spans) if i != 599] == [m["content"] for i, m in enumerate(turns) if i != 599]


def test_template_wrongly_said_to_be_local():
    def counted(messages):
        return "".join(f"[{m['content']}/{len(messages) // 600}]" for m in messages)

    with pytest.raises(ValueError):
        list(chat_format.spans(iter([{"role": "user", "content": "t"}] * 1100), counted, 64))


def test_many_matches_in_one_text(spark):
    text = "é token=abcdefgh1 " * 3000
    df = spark.createDataFrame([(1, text)], DOCS)
    (r,) = secrets.scan_secrets(df).collect()
    assert [(s.start, s.end) for s in r.found if s.kind == "assign"] == [(18 * i + 2, 18 * i + 17) for i in range(3000)]
