import random

import pytest
from pyspark.sql import functions as F

from gristmill.functions import text
from gristmill.functions.fixed import CJK
from gristmill.operators import chunking
from gristmill.plans.catalog import queries


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "given, tokens",
    [
        ("混合检索 Hybrid Retrieval", ["混合", "合检", "检索", "hybrid", "retrieval"]),
        ("猫", ["猫"]),
        ("", []),
        (None, []),
        ("第 2 章 v1.0.0 C++ #tag 线程数thread", ["第", "章", "线程", "程数", "2", "v1.0.0", "c++", "#tag", "thread"]),
        ("word. - ## ...", ["word.", "-", "##", "..."]),
    ],
)
def test_tokens(spark, given, tokens):
    assert one(spark, text.tokenize("t"), t=given) == tokens


@pytest.mark.parametrize(
    "given, parts",
    [
        ("第一句。第二句！Third one? Fourth.", ["第一句。", "第二句！", "Third one?", "Fourth."]),
        ("很长的一个句子内容。好。", ["很长的一个句子内容。好。"]),
        ("a; b!\n\nhello world!! ok", ["a;b!", "hello world!!ok"]),
        ("  ", []),
    ],
)
def test_sentences(spark, given, parts):
    assert one(spark, text.sentences("t"), t=given) == parts
    from gristmill.operators.chunking import sentences

    assert sentences(given) == parts


def test_similarities(spark):
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    row = spark.range(1).select(
        text.jaccard(a(), a()).alias("both"), text.jaccard(a("x"), a()).alias("one"), text.overlap_coefficient(a("a", "b"), a("a")).alias("half")
    ).first()
    assert (row.both, row.one, row.half) == (1.0, 0.0, 0.5)


@pytest.mark.parametrize("value", [90.0, 1.5, 0.0, -0.25, 1609.344, 1e-7, 123456789.125, 1.23456789012e15 + 0.5, 2.0**53, 1 / 3, 1234567890123.4, -1e-12])
def test_number_format(spark, value):
    expected = str(int(round(value))) if abs(value - round(value)) < 1e-9 else f"{value:.10g}"
    assert spark.range(1).select(text.format_number(F.lit(value)).alias("x")).first().x == expected


def test_citations_and_claims(spark):
    assert one(spark, text.strip_citations("t"), t="结论 [doc#1] 成立") == "结论   成立"
    assert one(spark, text.strip_citations("t"), t="x (依据：cpu#3)") == "x  "
    assert one(spark, text.strip_citations("t"), t="区间 [0, 1] 内") == "区间 [0, 1] 内"
    assert one(spark, text.is_claim("t"), t="Is this one?") is False
    assert one(spark, text.is_claim("t"), t="This is a claim") is True
    assert one(spark, text.is_claim("t"), t="证据不足，无法回答该问题。") is False


def test_slices_and_excerpt(spark):
    assert one(spark, text.slices("t"), t="x" * 50) == ["x" * 24, "x" * 24, "xx"]
    assert one(spark, text.slices("t"), t="") == []
    assert one(spark, text.best_excerpt("q", "t"), q="blue whale", t="red fish! the blue whale? blue") == "the blue whale?"
    assert one(spark, text.approx_tokens("t"), t="线程abcd") == 4


def test_sentences_of_odd_and_long_texts(spark):
    rng = random.Random(4)
    rows = [("".join(rng.choice("ab. ;?\n。！\u3000\x85\t\x1c") for _ in range(rng.randint(0, 40))),) for _ in range(400)]
    rows += [("word " * 50_000,), ("One two; " * 20_000,), (" ;" * 20_000,)]
    df = spark.createDataFrame(rows, "t string")
    assert all(r.s == chunking.sentences(r.t) for r in df.select("t", text.sentences("t").alias("s")).collect())
    plan = df.select(text.sentences("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan  # an array that grows by a copy for each sentence takes the square of their number


def test_sentence_counts_of_null(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, "One two. No.")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, queries()["sentence_split_counts"](spark, str(tmp_path)).collect())) == [(1, None, 0), (2, 1, 12)]


def test_pairs_of_next_ids(spark, tmp_path):
    """Ids with gaps, repeats and null, below zero and over the ends of blocks; each text is shuffled once and tokenised once."""
    rng = random.Random(5)
    ids = [None, -65, -64, -1, 0, 1, 63, 64, 64, 65, 65, 127, 128, 130, 2**40 + 63, 2**40 + 64]
    rows = [(i, None if n == 4 else " ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 6)))) for n, i in enumerate(ids)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries()["jaccard_pairs"](spark, str(tmp_path))
    want = []
    for i, a in rows:
        for j, b in rows:
            if i is not None and j == i + 1:
                a_, b_ = set((a or "").split()), set((b or "").split())
                want.append((i, round(len(a_ & b_) / len(a_ | b_), 6) if a_ | b_ else 1.0, round(len(a_ & b_) / len(a_), 6) if a_ else 0.0))
    assert sorted(map(tuple, out.collect())) == sorted(want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Relation") == 1


def test_tokens_as_by_plain_patterns(spark):
    rng = random.Random(6)
    rows = [("".join(rng.choice("aB1_-+#. ,éÑß猫混ーかㄱ가㐀豈٣²\n☂\U00020000İ") for _ in range(rng.randint(0, 40))),) for _ in range(400)]
    flat = F.regexp_replace(F.lower("t"), f"[{CJK}]", " ")
    plain = F.regexp_extract_all(flat, F.lit(r"[\p{L}\p{N}_\-+#.]+"), F.lit(0))
    runs = F.regexp_extract_all("t", F.lit(f"[{CJK}]+"), F.lit(0))
    found = spark.createDataFrame(rows, "t string").select(text.latin_runs("t").alias("a"), plain.alias("b"), F.array_join(text.cjk_bigrams("t"), " ").alias("c"), runs.alias("d")).collect()
    for r in found:
        assert r.a == r.b and r.c == " ".join(run[i : i + 2] for run in r.d for i in range(max(1, len(run) - 1)))
    assert "regexp_replace" not in spark.range(1).select(text.tokenize(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()  # one pattern over a text
