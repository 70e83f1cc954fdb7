"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes A-Z to a-z, every other byte as it is.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Also turns every ASCII byte that is no letter or digit into a space.
WORDS = bytes(
    c if (c := LOWER[b]) >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for b in range(256)
)
#: Settings of the session: Spark's default and ours.
_BATCHES = [
    ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"),
    ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"),
]
#: The six ASCII white-space characters, as bytes.split() and strip() see them.
BLANKS = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 1,000 rows and 4 MB, where the session has Spark's defaults: rows here hold whole texts."""
    for name, default, value in _BATCHES:
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, value)


@contextlib.contextmanager
def thin_batches(spark: SparkSession) -> Iterator[None]:
    """Within this, Arrow batches of 16,384 rows where the session has ours, and ours of 4 MB: for jobs whose rows are mostly a few numbers."""
    small_batches(spark)
    ours = all(spark.conf.get(name) == value for name, _, value in _BATCHES)
    try:
        if ours:
            spark.conf.set(_BATCHES[0][0], "16384")
        yield
    finally:
        if ours:
            spark.conf.set(_BATCHES[0][0], _BATCHES[0][2])


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one, set by us, only in local mode where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        folder = tempfile.mkdtemp(prefix="gristmill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which a worker that Spark keeps for other tasks gives back the memory that it doesn't use any more."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return tidied


class Scratch:
    """Tables in the shared folder that cut lineage; ``drop`` removes one that no later plan reads."""

    def __init__(self, spark: SparkSession):
        small_batches(spark)
        self.spark, self.root = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        self._delete(df._scratch_path for df in frames)

    def drop_but(self, *frames: DataFrame) -> None:
        """Drops every table but these."""
        kept = {df._scratch_path for df in frames}
        self._delete(path for i in range(self.n) if (path := f"{self.root}/{i + 1}") not in kept)

    def _delete(self, paths: Iterable[str]) -> None:
        jvm = self.spark.sparkContext._jvm
        for path in map(jvm.org.apache.hadoop.fs.Path, paths):
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def with_fields(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    """``schema`` with ``fields``; one of a name that is there already replaces it in place (names compare without case)."""
    new = {f.name.lower(): f for f in fields}
    kept = [new.pop(f.name.lower(), f) for f in schema.fields]
    return T.StructType([*kept, *(f for f in fields if f.name.lower() in new)])


def map_columns(
    df: DataFrame,
    reads: list[str],
    fields: list[T.StructField],
    make: Callable[[], Callable[..., dict[str, pa.Array]]],
) -> DataFrame:
    """Adds or replaces ``fields`` by Arrow batches, every other column passing through.

    ``make()`` runs once a task and gives a function from the arrays of ``reads``
    to a dict of arrays by field name. Strings in ``reads`` come as binary.
    """
    small_batches(df.sparkSession)
    schema = with_fields(df.schema, *fields)
    names = [f.name for f in schema.fields]
    made = {f.name.lower(): f.name for f in fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            at = {n.lower(): i for i, n in enumerate(batch.schema.names)}
            out = fn(*(as_bytes(batch.column(at[r.lower()])) for r in reads))
            yield pa.RecordBatch.from_arrays(
                [out[made[n.lower()]] if n.lower() in made else batch.column(at[n.lower()]) for n in names], names
            )

    return df.mapInArrow(tidy(run), schema)


def as_bytes(column: pa.Array) -> pa.Array:
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return column


def as_text(values: list) -> pa.Array:
    """Bytes in UTF-8, or None, as a string array."""
    return pa.array(values, pa.binary()).cast(pa.string())


def slices(batch: pa.RecordBatch, rows: int = 256, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, of so many rows and about so many bytes at most, so that derived arrays stay small."""
    step = max(1, min(rows, int(rows * size / max(1, batch.nbytes * rows / max(1, batch.num_rows)))))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def doc_key(name: str = "doc_id"):
    """A document's id, null below every number."""
    return F.coalesce(F.col(name).cast("long"), F.lit(-(2**63)))
