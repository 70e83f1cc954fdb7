"""The engine's tables as append-only segments.

An update writes one segment: its own documents, chunks and indexes, and the ids of
the chunks and documents that it puts out of date. Nothing older is rewritten; a read
takes the rows of all segments less those that a later one has put out of date. A
segment counts from the moment its number is within ``last``, so that one left half
written by a lost driver is written over. ``compact`` merges all of them into one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ivf
from ..schemas import CHUNK, DOCUMENT
from .steps import Steps

#: Table to its schema and the key by which rows go out of date.
TABLES = {
    "documents": (DOCUMENT, "doc_id"),
    "chunks": (CHUNK, "chunk_id"),
    "lengths": ("chunk_id string, dl int", "chunk_id"),
    "postings": ("chunk_id string, term string, dl int, tf long", "chunk_id"),
    "vectors": ("chunk_id string, slots array<int>, weights array<double>, apart double, cell int", "chunk_id"),
}
#: Ids put out of date, and what a segment adds to the counts of the corpus.
GONE = "kind string, id string"
COUNTS = "n_docs long, n_with_chunks long, n_chunks long, dl long"


class Segments:
    def __init__(self, spark: SparkSession):
        self.spark, self.steps, self.last = spark, Steps(spark), -1
        self.any_gone = False
        #: Of the vectors' cells, where there is an index: what made them, and their radii, of rows out of date too.
        self.quantiser, self.radii = None, {}

    def _path(self, table: str, segment: int | None = None) -> str:
        return f"{self.steps.root}/{table}" + ("" if segment is None else f"/segment={segment}")

    def _read(self, table: str, schema: str) -> DataFrame:
        if self.last < 0:
            return self.spark.createDataFrame([], schema + ", segment int")
        rows = self.spark.read.schema(schema + ", segment int").parquet(self._path(table))
        return rows.where(F.col("segment") <= self.last)

    def table(self, name: str) -> DataFrame:
        """The rows of a table that are not out of date."""
        schema, key = TABLES[name]
        rows = self._read(name, schema)
        if self.any_gone:
            gone = self._read("gone", GONE).where(F.col("kind") == key).select(F.col("id").alias(key), F.col("segment").alias("until"))
            gone = gone.groupBy(key).agg(F.max("until").alias("until"))
            rows = rows.join(gone, (rows[key] == gone[key]) & (gone["until"] > rows["segment"]), "left_anti")
        return rows.drop("segment")

    def counts(self) -> DataFrame:
        """One row: the sums of what the segments add and take away."""
        return self._read("counts", COUNTS).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("n_docs", "n_with_chunks", "n_chunks", "dl")))

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Writes a table of the segment to come and reads it again."""
        schema = self.spark.createDataFrame([], TABLES[name][0]).schema
        rows = df.select(*(F.col(f.name).cast(f.dataType) for f in schema.fields))
        path = self._path(name, self.last + 1)
        if name == "vectors":  # a folder for each cell of an index
            ivf.write(rows, path, self.quantiser is not None)
            return self.spark.read.schema(schema).parquet(path)
        if name == "postings":  # they lie by term, so that a search reads its terms' neighbourhood only
            rows = rows.repartitionByRange(F.col("term")).sortWithinPartitions("term")
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def commit(self, made: dict[str, DataFrame], gone: DataFrame | None = None) -> None:
        """Adds the segment whose tables ``made`` has, as written; ``gone``: chunk_id, doc_id, dl of the chunks that it replaces, and documents without chunks."""
        one = made["documents"].agg(F.count(F.lit(1)).alias("n_docs"))
        chunks = made["chunks"].agg(F.count_distinct("doc_id").alias("n_with_chunks"), F.count(F.lit(1)).alias("n_chunks"))
        added = one.join(chunks).join(made["lengths"].agg(F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")))
        if gone is not None:
            ids = gone.select(F.lit("chunk_id").alias("kind"), F.col("chunk_id").alias("id")).where("id IS NOT NULL")
            ids = ids.union(gone.select(F.lit("doc_id"), "doc_id").distinct())
            ids.write.mode("overwrite").parquet(self._path("gone", self.last + 1))
            less = gone.agg(
                F.count_distinct("doc_id").alias("g_docs"),
                F.count_distinct(F.when(F.col("chunk_id").isNotNull(), F.col("doc_id"))).alias("g_with"),
                F.count("chunk_id").alias("g_chunks"),
                F.coalesce(F.sum("dl"), F.lit(0)).alias("g_dl"),
            )
            added = added.join(less).select(
                *((F.col(a) - F.col(b)).alias(a) for a, b in (("n_docs", "g_docs"), ("n_with_chunks", "g_with"), ("n_chunks", "g_chunks"), ("dl", "g_dl")))
            )
        else:
            self.spark.createDataFrame([], GONE).write.mode("overwrite").parquet(self._path("gone", self.last + 1))
        added.write.mode("overwrite").parquet(self._path("counts", self.last + 1))
        self.last += 1
        self.any_gone = self.any_gone or gone is not None

    def compact(self, index: Callable[[Segments, DataFrame], dict[str, DataFrame]]) -> Segments:
        """All segments as one, elsewhere; ``index`` writes the indexes of its chunks. What is here stays until dropped."""
        out = Segments(self.spark)
        made = {name: out.write(name, self.table(name)) for name in ("documents", "chunks")}
        out.commit(made | index(out, made["chunks"]))
        return out

    def drop(self) -> None:
        self.steps.drop()
