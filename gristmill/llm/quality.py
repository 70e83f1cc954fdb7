"""Quality by importance resampling.

Two generative models of hashed word unigrams and bigrams: the target's, from the
documents that are labelled good, and the raw one, from all documents. A text's
log importance is the sum of the log ratios of its n-grams. Gumbel noise, a function
of the document alone, is added, and the k greatest are the sample: k draws without
replacement in proportion to the weights.

The cut between k-th and next is found on counts in a bounded number of bins, again
and again within the bin that holds it; nothing is sorted as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, Scratch, as_bytes, doc_key, map_columns, table, tidy

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class Features:
    """Buckets of a text's words and neighbouring pairs; word hashes are kept within a bound."""

    def __init__(self, buckets: int, kept: int = 150_000):
        self.buckets, self.kept, self.seen = np.uint64(buckets), kept, {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").translate(LOWER).split()
        new = set(words).difference(self.seen)
        if new:
            if len(self.seen) + len(new) > self.kept:
                self.seen.clear()
                new = set(words)
            self.seen.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
        h = np.fromiter(map(self.seen.__getitem__, words), np.uint64, len(words))
        pairs = (h[:-1] * _STEP + h[1:]) * _MIX
        return (np.concatenate([h, pairs ^ (pairs >> np.uint64(29))]) % self.buckets).astype(np.int64)


def _counts(docs: DataFrame, good: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts by bucket over the good rows, and over all: one pair of arrays a task, added up bucket by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(buckets), np.zeros((2, buckets), np.int64)
        for batch in batches:
            for text, own in zip(as_bytes(batch.column(0)).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = np.bincount(features(text), minlength=buckets)
                total[1] += n
                if own:
                    total[0] += n
        at = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(t[at]) for t in total)], ["bucket", "good", "n"])

    marked = docs.select("doc_id", "text").join(F.broadcast(good.withColumn("good", F.lit(True))), "doc_id", "left")
    rows = marked.select("text", F.coalesce("good", F.lit(False)).alias("good")).mapInArrow(tidy(run), "bucket long, good long, n long")
    out = np.zeros((2, buckets), np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).collect():
        out[:, r.bucket] = r.good, r.n
    return out[0], out[1]


def log_ratio(target: np.ndarray, raw: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    p, q = (c + smoothing for c in (target.astype(float), raw.astype(float)))
    return np.log(p / p.sum()) - np.log(q / q.sum())


def _gumbel():
    """From a hash of id and text alike on every run: -log(-log u), u inside (0, 1)."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit("gumbel"), "doc_id", "text"), 11) + F.lit(0.5)) / F.lit(float(2**53))
    return -F.log(-F.log(u))


def resample(
    docs: DataFrame,
    labels: DataFrame,
    fraction: float | None = None,
    per_gram: float | None = None,
    buckets: int = 1 << 15,
    most_labels: int = 500_000,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_grams, log_weight, sampling_key, selected.

    ``labels``: doc_id, quality (1 good, 0 bad). ``log_weight`` is the
    sum of the log ratios of the text's n-grams, or, with ``per_gram``, so many times
    their mean, which is another law: one by which length does not count. A null or
    blank text has none and gets null, and is never selected. The sample holds ``fraction`` of the
    rows that have a weight, rounded; unless given, that is the share of good ones
    among the labels, so that as much is kept as is thought good. Where keys tie at the
    cut, smaller ids go first. Without good labels all ratios are 0 and the sample
    is uniform. Repeated rows have one key, and each counts. The target is learned
    from ``most_labels`` good documents at most, by a hash of the id; the raw model
    from all documents.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    judged = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    judged = scratch.write(judged)
    shares = judged.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("good")).first()
    if fraction is None:
        fraction = shares.good / shares.n if shares.good else 1.0
    good = judged.where("quality = 1").select("doc_id")
    if shares.good > most_labels:
        good = good.orderBy(F.xxhash64(F.lit("target"), "doc_id"), "doc_id").limit(most_labels)
    target, raw = _counts(docs, good, buckets)
    ratio = spark.sparkContext.broadcast(log_ratio(target, raw) if shares.good else np.zeros(buckets))
    fields = [T.StructField("n_grams", T.LongType()), T.StructField("log_weight", T.DoubleType())]

    def make():
        features, table_ = Features(buckets), ratio.value

        def fn(texts: pa.Array) -> dict[str, pa.Array]:
            n, weight = [], []
            for text in texts.to_pylist():
                at = features(text)
                n.append(len(at))
                own = table_[at]
                weight.append(float(own.sum() if per_gram is None else per_gram * own.mean()) if len(at) else None)
            return {"n_grams": pa.array(n, pa.int64()), "log_weight": pa.array(weight, pa.float64())}

        return fn

    noisy = docs.select("doc_id", "text", _gumbel().alias("noise"))
    scored = map_columns(noisy, ["text"], fields, make)
    scored = scratch.write(scored.select("doc_id", "n_grams", "log_weight", (F.col("log_weight") + F.col("noise")).alias("sampling_key")))
    scratch.drop(judged)
    k = round(fraction * scored.where("log_weight IS NOT NULL").count())
    key, lesser = F.col("sampling_key"), -doc_key().cast("decimal(20,0)")
    weighed = scored.where(key.isNotNull())
    if k <= 0:
        return scored.withColumn("selected", F.lit(False))
    edge, left, tied = _kth(weighed, key, k)
    above = key > edge
    if left == tied:
        above = key >= edge
    else:  # the least ids of those that tie at the cut, as long as all rows of an id have room
        last, left, tied = _kth(weighed.where(key == edge), lesser, left)
        inside = lesser >= F.lit(last) if left == tied else lesser > F.lit(last)
        above = above | (key == edge) & inside
    return scored.withColumn("selected", F.coalesce(above, F.lit(False)))


def _kth(rows: DataFrame, value, k: int, bins: int = 4096):
    """The k-th greatest value (of ``k`` or more rows), how many rows of it are among the k greatest, and how many there are.

    Values are doubles, or decimals without a fraction.
    """
    rows = rows.select(value.alias("v"))
    low, high, total = rows.agg(F.min("v"), F.max("v"), F.count(F.lit(1))).first()
    while low != high:
        if isinstance(low, float):
            at = F.floor((F.col("v") - low) / (high - low) * bins)
        else:
            at = F.floor((F.col("v") - F.lit(low)) / F.lit((high - low) // bins + 1))
        inside = rows.where((F.col("v") >= F.lit(low)) & (F.col("v") <= F.lit(high))).groupBy(at.alias("bin"))
        counts = inside.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n")).collect()
        for r in sorted(counts, key=lambda r: r.high, reverse=True):  # at most bins + 1 of them
            if r.n >= k:
                break
            k -= r.n
        low, high, total = r.low, r.high, r.n
    return low, k, total


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of ``documents``: its importance for the good labelled text, and whether the sample holds it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
