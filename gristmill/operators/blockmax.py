"""BM25 over postings in blocks, of which those that can't reach a query's best k are never opened.

Chunks are dealt to buckets; a block is a term's postings in one bucket, with the
greatest term frequency and the least length in it, which bound what any of them can
add to a score. A query's rarest terms give it k scores in part, so a threshold that
its k best reach; a bucket whose blocks together stay below it is left out for that
query. Only blocks that some query still needs are joined with their postings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sparse import best_of, counts, robertson_idf, tokens

#: Scores are rounded to as many digits or more before they are compared.
SLACK = 2e-6


def blocks(postings: DataFrame, n_chunks: int, per_bucket: int = 64) -> DataFrame:
    """(term, bucket, n, max_tf, min_dl, rows) of postings (chunk_id, term, tf, dl); a block has a row for each of its chunks."""
    bucket = F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, -(-n_chunks // per_bucket)))).alias("bucket")
    return postings.groupBy("term", bucket).agg(
        F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.collect_list(F.struct("chunk_id", "tf", "dl")).alias("rows")
    )


def index(chunks: DataFrame, per_bucket: int = 64) -> DataFrame:
    """``blocks`` of chunks (chunk_id, text or tokens): a bucket is a stretch of chunks that lie together, so nothing is shuffled.

    Write it down before it is used: buckets are numbered as tasks read them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bucket = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, batch.num_rows, per_bucket):
                part = batch.slice(start, per_bucket)
                row, term, tf, names = counts(part.column(1))
                dl = part.column(2).to_numpy()[row]
                order = np.argsort(term, kind="stable")
                row, term, tf, dl = row[order], term[order], tf[order], dl[order]
                held, first, n = np.unique(term, return_index=True, return_counts=True)
                rows = pa.StructArray.from_arrays([part.column(0).take(pa.array(row)), pa.array(tf.astype(np.int64)), pa.array(dl)], ["chunk_id", "tf", "dl"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), rows)
                most, least = (f.reduceat(x, first) if len(first) else x for f, x in ((np.maximum, tf.astype(np.int64)), (np.minimum, dl)))
                columns = [names.take(pa.array(held)), pa.array(np.full(len(held), bucket)), pa.array(n.astype(np.int64)), pa.array(most), pa.array(least), lists]
                yield pa.RecordBatch.from_arrays(columns, ["term", "bucket", "n", "max_tf", "min_dl", "rows"])
                bucket += 1

    rows = tokens(chunks).select(F.col("chunk_id").cast("string").alias("chunk_id"), "tokens", F.greatest(F.lit(1), F.size("tokens")).alias("dl"))
    return rows.mapInArrow(run, "term string, bucket long, n long, max_tf long, min_dl int, rows array<struct<chunk_id: string, tf: long, dl: int>>")


def _gain(qtf: Column, idf: Column, tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    return qtf * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def needed(
    index: DataFrame, stats: DataFrame, q: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, cut: Callable[[DataFrame], DataFrame] = lambda df: df
) -> tuple[DataFrame, DataFrame]:
    """Of ``q`` (query_id, term, qtf): the terms with idf and avgdl, and the (query_id, bucket) that may hold one of its best ``k``."""
    heads = cut(index.select("term", "bucket", "n", "max_tf", "min_dl").join(q.select("term").distinct(), "term", "left_semi"))
    df = heads.groupBy("term").agg(F.sum("n").alias("df")).join(F.broadcast(stats))  # one row of statistics
    terms = cut(q.join(df.select("term", "df", robertson_idf(F.col("n_docs"), F.col("df")).alias("idf"), "avgdl"), "term"))
    # The rarest terms of each query that have k postings between them.
    order = Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    rare = terms.withColumn("before", F.coalesce(F.sum("df").over(order), F.lit(0))).where(F.col("before") < k)
    part = scored(index, rare, None, k1, b)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    floor = part.withColumn("r", best).where(F.col("r") == k).select("query_id", F.col("score").alias("floor"))
    bound = _gain(F.col("qtf"), F.col("idf"), F.col("max_tf"), F.col("min_dl"), F.col("avgdl"), k1, b)
    buckets = heads.join(terms, "term").groupBy("query_id", "bucket").agg(F.sum(bound).alias("bound"))
    buckets = buckets.join(floor, "query_id", "left").where(F.col("bound") >= F.coalesce("floor", F.lit(0.0)) - SLACK)
    return terms, cut(buckets.select("query_id", "bucket"))


def scored(index: DataFrame, terms: DataFrame, buckets: DataFrame | None, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, chunk_id, score) from the blocks of ``terms`` (query_id, term, qtf, idf, avgdl), in ``buckets`` only, if given."""
    asked = terms.select("query_id", "term", "qtf", "idf", "avgdl")
    if buckets is None:
        rows = index.join(asked, "term")
    else:
        rows = index.join(asked.join(buckets, "query_id"), ["term", "bucket"])
    rows = rows.select("query_id", "qtf", "idf", "avgdl", F.explode("rows").alias("p"))
    gain = _gain(F.col("qtf"), F.col("idf"), F.col("p.tf"), F.col("p.dl"), F.col("avgdl"), k1, b)
    return rows.groupBy("query_id", F.col("p.chunk_id").alias("chunk_id")).agg(F.round(F.sum(gain), 12).alias("score"))


def search(index: DataFrame, stats: DataFrame, q: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, digits: int = 12, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(query_id, chunk_id, score, rank): as an exhaustive search gives them, scores rounded to ``digits`` (six or more).

    The buckets that some query needs are opened for all: a chunk of one that a query
    doesn't need stays below its ``k`` best.
    """
    terms, buckets = needed(index, stats, q, k, k1, b, cut)
    df = {r.term: r.df for r in terms.select("term", "df").distinct().collect()}  # no more rows than ``q``
    opened = index.join(terms.select("term").distinct(), "term", "left_semi").join(buckets.select("bucket").distinct(), "bucket", "left_semi")
    rows = opened.select("term", F.explode("rows").alias("p")).select("p.chunk_id", "term", "p.tf", "p.dl")
    return best_of(rows, stats, q, k, k1, b, digits, df=df)
