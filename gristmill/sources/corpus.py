"""Sources and sinks of documents, cases and chunks."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..schemas import CASE, CHUNK, DOCUMENT

SUFFIXES = ("md", "txt", "rst")


def _stem():
    name = F.element_at(F.split(F.url_decode("_metadata.file_path"), "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def _last_of_stem(df: DataFrame) -> DataFrame:
    """Files of one stem overwrite each other; the last path stays."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("path"))
    return df.withColumn("n", F.row_number().over(order)).where("n = 1").select("doc_id", "text")


def read_texts(spark: SparkSession, *paths: str, suffixes: Iterable[str] = SUFFIXES) -> DataFrame:
    """(doc_id, text) of whole files: folders with all below, by suffix in either case; doc_id is the file's stem.

    A path may be a pattern. What it matches is read, files of any suffix; one that
    matches nothing gives a warning.
    """
    pattern = rf"(?i)\.({'|'.join(suffixes)})$"
    files, folders = [], []
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for p in paths:
        path = hadoop(p)
        found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
        if not len(found):
            warnings.warn(f"no file at {p}", stacklevel=2)
        for status in found:
            (folders if status.isDirectory() else files).append(status.getPath().toString())
    rows = None
    for own, folder in ((files, False), (folders, True)):
        if not own:
            continue
        df = spark.read.text([re.sub(r"([][{}*?\\])", r"\\\1", p) for p in own], wholetext=True, recursiveFileLookup=folder)
        df = df.select(_stem().alias("doc_id"), F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
        df = df.where(F.col("path").rlike(pattern)) if folder else df
        rows = df if rows is None else rows.unionByName(df)
    return spark.createDataFrame([], DOCUMENT) if rows is None else _last_of_stem(rows)


def from_mapping(spark: SparkSession, texts: Mapping[str, str] | Iterable[tuple[str, str]]) -> DataFrame:
    """(doc_id, text); of pairs with one key the last counts."""
    return spark.createDataFrame(list(dict(texts).items()), DOCUMENT)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from a JSON array, numbered in its order."""
    rows = spark.read.schema(CASE).json(path, multiLine=True)
    return rows.withColumn("at", F.monotonically_increasing_id()).select(
        F.format_string("q%04d", F.row_number().over(Window.orderBy("at"))).alias("query_id"), *rows.columns
    )


def spread(df: DataFrame) -> DataFrame:
    """A small table of few splits over all cores; one with splits enough as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = df._jdf.queryExecution().toRdd().getNumPartitions() < cores
    return df.repartition(cores) if few else df


def not_blank(docs: DataFrame) -> DataFrame:
    """Documents with text; a null one counts as blank."""
    return docs.where(strip(F.coalesce(F.col("text"), F.lit(""))) != "")


def last_of_each(rows: DataFrame, key: str) -> DataFrame:
    """Of rows with one key the last: of the greatest ``revision``, where there is such a column, and then in reading order.

    Reading order is that of the splits of ``rows`` as they are now; after a shuffle
    it says nothing, so rows that were shuffled need revisions.
    """
    at, n = (_free(name, rows.columns) for name in ("at", "n"))
    by = [F.desc("revision")] if "revision" in rows.columns else []
    order = Window.partitionBy(key).orderBy(*by, F.desc(at))
    numbered = rows.withColumn(at, F.monotonically_increasing_id())
    return numbered.withColumn(n, F.row_number().over(order)).where(F.col(n) == 1).drop(at, n)


def _free(name: str, columns: list[str]) -> str:
    """``name`` with as many underscores as it takes to be none of ``columns``."""
    held = {c.lower() for c in columns}
    while name in held:
        name += "_"
    return name


def replace_revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` with every document of ``new`` put in its place, the last revision of each; blank ones of ``new`` replace nothing."""
    new = last_of_each(not_blank(new), "doc_id")
    return old.join(new.select("doc_id"), "doc_id", "left_anti").unionByName(new)


def write_chunks(chunks: DataFrame, path: str, kind: str = "json") -> int:
    chunks.orderBy("chunk_id").write.mode("overwrite").format(kind).save(path)
    return chunks.count()


def read_chunks(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """Chunks as written; none, and a warning, where there is no such path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        warnings.warn(f"no file at {path}", stacklevel=2)
        return spark.createDataFrame([], CHUNK)
    return spark.read.schema(CHUNK).format(kind).load(path).where("chunk_id IS NOT NULL")
