"""Language ID: string kernels, Nyström landmarks, one-versus-rest kernel ridge regression.

The kernel of two texts is the blended spectrum of byte n-grams: for each length
n the number of n-grams that both hold, over the geometric mean of how many each
holds, averaged over n. A bounded sample of labelled rows is learned from. Some
of it are landmarks; kernels with these, whitened, are a text's features, and a
ridge regression for each language sets the weights. Texts are scored in batches:
presence matrix times landmark matrix, then times weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, doc_key, map_columns, slices, table, tidy

GRAMS = (2, 3, 4)
_BITS = 20
_LETTERLIKE = re.compile(r"[^\W\d_]")  # letters, and numbers that are no decimal digits
_BLANKS = re.compile(rb"[^a-z\x80-\xff]+")


class Grams:
    """Distinct n-grams of a text, as numbers under 2**20, for each n; letters only, blanks as one space."""

    def __init__(self):
        self.last = np.zeros(1 << _BITS, np.int32)

    def __call__(self, text: str) -> list[np.ndarray]:
        low = b" " + _BLANKS.sub(b" ", text.lower().encode()).strip() + b" "
        b = np.frombuffer(low, np.uint8).astype(np.uint32)
        out = []
        for n in GRAMS:
            m = len(b) - n + 1
            if m <= 0:
                out.append(np.empty(0, np.int64))
                continue
            code = b[:m].copy()
            for i in range(1, n):
                code = code * np.uint32(256) + b[i : m + i]
            at = ((code * np.uint32(2654435769)) >> np.uint32(32 - _BITS)).astype(np.int64)
            self.last[at] = np.arange(m, dtype=np.int32)
            out.append(at[self.last[at] == np.arange(m)])  # the last place of each
        return out


@dataclass
class Model:
    languages: list[str]
    vocabulary: list[np.ndarray]  # by n: column of an n-gram number, or -1
    landmarks: list[np.ndarray]  # by n: columns x landmarks, scaled
    weights: np.ndarray  # landmarks x languages


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTERLIKE.finditer(text))


def _kernel(grams: list[list[np.ndarray]], columns: list[np.ndarray], marks: list[np.ndarray]) -> np.ndarray:
    """Texts x landmarks: for each n a presence matrix times the landmarks' one."""
    total = np.zeros((len(grams), marks[0].shape[1]), np.float32)
    for k in range(len(GRAMS)):
        present = np.zeros((len(grams), marks[k].shape[0]), np.float32)
        for i, g in enumerate(grams):
            own = columns[k][g[k]]
            present[i, own[own >= 0]] = 1 / np.sqrt(max(1, len(g[k])))
        total += present @ marks[k]
    return total / len(GRAMS)


def _reach(grams: list[list[np.ndarray]], sizes: list[np.ndarray]) -> np.ndarray:
    """Texts: the greatest kernel with landmarks of these sizes that a text's own size permits, on average."""
    total = np.zeros(len(grams))
    for k, size in enumerate(sizes):
        own = np.array([max(1, len(g[k])) for g in grams])[:, None]
        total += np.sqrt(np.minimum(own, size) / np.maximum(own, size)).mean(1)
    return total / len(sizes)


def train(sample: list[tuple[list[np.ndarray], str]], landmarks: int, ridge: float) -> Model:
    """From (distinct n-grams, language) rows in an order of their own; landmarks go round the languages."""
    languages = sorted({lang for _, lang in sample})
    by = {lang: [g for g, own in sample if own == lang] for lang in languages}
    marks: list[list[np.ndarray]] = []
    for i in range(max(map(len, by.values()))):
        marks += [by[lang][i] for lang in languages if i < len(by[lang])]
    marks = marks[:landmarks]
    columns, scaled = [], []
    for k in range(len(GRAMS)):
        known = np.unique(np.concatenate([g[k] for g in marks]))
        column = np.full(1 << _BITS, -1, np.int32)
        column[known] = np.arange(len(known))
        matrix = np.zeros((max(1, len(known)), len(marks)), np.float32)
        for j, g in enumerate(marks):
            matrix[column[g[k]], j] = 1 / np.sqrt(max(1, len(g[k])))
        columns.append(column)
        scaled.append(matrix)
    between = _kernel(marks, columns, scaled).astype(float)
    values, vectors = np.linalg.eigh((between + between.T) / 2)
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    features = np.concatenate(
        [_kernel([g for g, _ in sample[i : i + 64]], columns, scaled) @ whiten for i in range(0, len(sample), 64)]
    )
    target = np.array([[lang == own for lang in languages] for _, own in sample], float)
    weight = 1 / target.sum(0)[target.argmax(1)]  # each language counts the same
    weight *= len(sample) / weight.sum()
    left = features.T @ (features * weight[:, None]) + ridge * np.eye(features.shape[1])
    weights = whiten @ np.linalg.solve(left, features.T @ (target * weight[:, None]))
    return Model(languages, columns, scaled, weights.astype(np.float32))


def _sample(labelled: DataFrame, per_language: int, most: int) -> list[tuple[list[np.ndarray], str]]:
    """At most ``most`` labelled rows, ``per_language`` of each language, by a hash of id and text; equal rows are one."""
    keyed = labelled.withColumn("h", F.xxhash64(F.lit("language-id"), "doc", "text"))
    # Of each language about eight times the rows wanted have hashes low enough to be looked at, whatever its size.
    sizes = keyed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    place = (F.col("h").cast("double") + 2.0**63) / 2.0**64
    low = keyed.select("doc", "lang", "h").join(F.broadcast(sizes), "lang").where(place <= 8.0 * per_language / F.col("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc"))
    ids = low.select("doc", "lang", "h").distinct().withColumn("r", rank).where(F.col("r") <= per_language)
    ids = ids.orderBy("r", "h", "doc", "lang").limit(most).select("doc", "lang", "h")
    schema = "doc long, lang string, grams array<array<int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            docs, langs, found = [], [], []
            for doc, lang, text in zip(*(as_bytes(c).to_pylist() for c in batch.columns), strict=True):
                if has_letter(text := text.decode()):
                    docs.append(doc)
                    langs.append(lang.decode())
                    found.append([np.sort(g).astype(np.int32) for g in grams(text)])
            arrays = [pa.array(docs, pa.int64()), pa.array(langs, pa.string()), pa.array(found, pa.list_(pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc", "lang", "grams"])

    picked = keyed.join(F.broadcast(ids), ["doc", "lang", "h"], "left_semi").dropDuplicates(["doc", "lang", "h"])
    rows = picked.select("doc", "lang", "text").mapInArrow(tidy(run), schema).collect()
    rows.sort(key=lambda r: (r.doc, r.lang, r.grams))
    return [([np.array(g, np.int64) for g in r.grams], r.lang) for r in rows]


def fit(
    docs: DataFrame, per_language: int = 300, most: int = 1500, landmarks: int = 240, ridge: float = 0.1
) -> Model | None:
    """Learns from the rows of ``docs`` (doc_id, text, lang) that have a language and a letter; None if none has.

    The bound: ``per_language`` rows of a language, ``most`` in all.
    """
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(doc_key().alias("doc"), "lang", "text")
    sample = _sample(labelled, per_language, most)
    return train(sample, landmarks, ridge) if sample else None


def predict(docs: DataFrame, model: Model | None, prefix: str = "", relative: bool = False) -> DataFrame:
    """``docs`` (text, anything else) with ``lang_pred`` string and ``score`` double, 0 to 1.

    The language of the greatest regression value, ties to the first by name;
    the score is that value, cut to 0..1. ``und`` and 0 where a text is null or
    has no letter, and for all where there was nothing to learn from. ``relative``:
    the value is first taken over what a text of that length can reach. Columns of
    those names (after ``prefix``) are replaced.
    """
    lang_name, score_name = f"{prefix}lang_pred", f"{prefix}score"
    fields = [T.StructField(lang_name, T.StringType()), T.StructField(score_name, T.DoubleType())]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m, grams = sent.value, Grams()
        sizes = [1 / np.maximum(marks.max(0), 1e-6) ** 2 for marks in m.landmarks] if m is not None and relative else []

        def fn(texts: pa.Array) -> dict[str, pa.Array]:
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            start = 0
            for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), 64):
                at, found = [], []
                for i, text in enumerate(part.column(0).to_pylist(), start):
                    if text is not None and m is not None and has_letter(text := text.decode()):
                        at.append(i)
                        found.append(grams(text))
                start += part.num_rows
                if at:
                    values = _kernel(found, m.vocabulary, m.landmarks) @ m.weights
                    if relative:
                        values = values / _reach(found, sizes)[:, None]
                    best = values.argmax(1)
                    score[at] = np.clip(values[np.arange(len(at)), best], 0, 1)
                    for i, b in zip(at, best, strict=True):
                        lang[i] = m.languages[b]
            return {lang_name: pa.array(lang, pa.string()), score_name: pa.array(score)}

        return fn

    return map_columns(docs, ["text"], fields, make)


def held_out():
    """True for a third of all ids: those never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def keep_known(docs: DataFrame, least: float = 0.1, **bounds) -> DataFrame:
    """The rows of ``docs`` whose text has a language: not ``und``, and a score of ``least`` or more for its length. Columns stay."""
    prefix, own = "__", {c.lower() for c in docs.columns}
    while f"{prefix}lang_pred" in own or f"{prefix}score" in own:
        prefix += "_"
    found = predict(docs, fit(docs, **bounds), prefix, relative=True)
    kept = found.where((F.col(f"{prefix}lang_pred") != "und") & (F.col(f"{prefix}score") >= least))
    return kept.drop(f"{prefix}lang_pred", f"{prefix}score")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of ``documents``: its predicted language; learned from two thirds of the ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model).select(
        "doc_id", "held_out", "lang_pred", "score"
    )
