"""Line dedup: drops lines that many documents share, all but in one document.

Two Bloom filters find the suspects. Every task reads its documents and sends
only 64-bit hashes of the lines of a document, summed within a batch to "once"
or "more than once". The task that owns a slice of hashes, of which there are as
many as the counted lines need, streams them through a once-seen and a twice-seen
filter; what the second takes in is suspected. The suspected hashes make one small
filter whose size is checked before it is sent out; where it would be too large,
lines come to the suspected hashes by a join instead. Only suspected lines go on to
the exact count of documents, as (digest, doc_id), and to the choice of the one that
keeps them. The confirmed lines are sent out, or come to their documents by joins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, LOWER, Scratch, as_bytes, as_text, doc_key, map_columns, table, tidy

PROBES = 4


class Bloom:
    """A Bloom filter over arrays of 64-bit hashes; one byte a slot while it is built."""

    def __init__(self, slots: int, packed: bytes | None = None):
        self.mask = np.uint64(slots - 1)  # slots: a power of two
        self.slot = np.unpackbits(np.frombuffer(packed, np.uint8)) if packed else np.zeros(slots, np.uint8)

    def _at(self, h: np.ndarray) -> Iterator[np.ndarray]:
        step = (h >> np.uint64(32)) | np.uint64(1)
        for i in range(PROBES):
            yield (h + np.uint64(i) * step) & self.mask

    def add(self, h: np.ndarray) -> None:
        for at in self._at(h):
            self.slot[at] = 1

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for at in self._at(h):
            found &= self.slot[at] == 1
        return found

    def packed(self) -> bytes:
        return np.packbits(self.slot).tobytes()


def slots_for(n: int) -> int:
    return 1 << max(12, (16 * max(1, n) - 1).bit_length())


def line_keys(text: bytes | None, min_chars: int) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text, and of each its key, or None where that is too short to count."""
    text = text or b""
    keys: list[bytes | None] = []
    for line in text.translate(LOWER).split(b"\n"):
        key = line.strip(BLANKS)
        short = len(key) < min_chars or not key.isascii() and len(key.decode()) < min_chars
        keys.append(None if short else key)
    return text.split(b"\n"), keys


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _suspects(docs: DataFrame, min_chars: int, slice_slots: int) -> DataFrame:
    """Hashes that the once-seen filter knew already when they came again, each once or a little oftener."""
    lines = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-16 * lines // slice_slots))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h64 = xxhash.xxh3_64_intdigest
        for batch in batches:
            found: list[int] = []
            for text in as_bytes(batch.column(0)).to_pylist():
                found += {h64(k) for k in line_keys(text, min_chars)[1] if k is not None}
            h, n = np.unique(np.array(found, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n > 1)], ["h", "again"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = twice = None
        for batch in batches:
            if once is None:
                once, twice = Bloom(slice_slots), Bloom(slice_slots)
            h, first, n = np.unique(batch.column(0).to_numpy().view(np.uint64), return_index=True, return_counts=True)
            again = batch.column(1).to_numpy(zero_copy_only=False)
            more = (n > 1) | again[first] | once.has(h)
            new = h[more & ~twice.has(h)]
            once.add(h)
            twice.add(new)
            yield pa.RecordBatch.from_arrays([pa.array(new.view(np.int64))], ["h"])

    hashed = docs.select("text").mapInArrow(tidy(hashes), "h long, again boolean")
    return hashed.repartition(int(parts), F.col("h")).mapInArrow(tidy(stream), "h long")


def _merged(spark: SparkSession, suspects: DataFrame, slots: int) -> bytes:
    """One filter of the suspected hashes: a few tasks make one each, and those are merged here."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = Bloom(slots)
        for batch in batches:
            bloom.add(batch.column(0).to_numpy().view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array([bloom.packed()], pa.binary())], ["bits"])

    out = np.zeros(slots // 8, np.uint8)
    for row in suspects.coalesce(4).mapInArrow(tidy(build), "bits binary").toLocalIterator():
        out |= np.frombuffer(row.bits, np.uint8)
    return out.tobytes()


def dedup_lines(
    docs: DataFrame,
    min_docs: int = 3,
    min_chars: int = 20,
    max_filter_bytes: int = 32 << 20,
    max_table_rows: int = 300_000,
    slice_slots: int = 1 << 24,
) -> DataFrame:
    """``docs`` (doc_id, text, anything else) with ``text`` less its repeated lines, ``n_lines`` and ``n_dropped``.

    Lines are what stands between ``\\n``; a line's key is the line without
    white space at both ends, A-Z lower-cased. A key of ``min_chars`` code points
    or more that ``min_docs`` different doc_ids hold loses its lines in all
    documents but those with the largest doc_id among them, which keep each of
    them. A null or empty text is one empty line and comes out empty. A null
    doc_id counts as one more id, below all others. Rows that repeat, doc_id and
    all, are treated alike and count as one document. Columns of the input named
    n_lines or n_dropped are replaced; an empty table stays empty.

    ``slice_slots``: bytes that each of the two filters of a slice takes while
    it is built. A fuller filter suspects more lines and changes no result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    suspects = scratch.write(_suspects(docs, min_chars, slice_slots))
    slots = slots_for(suspects.count())
    small = slots // 8 <= max_filter_bytes
    bits = spark.sparkContext.broadcast(_merged(spark, suspects, slots)) if small else None

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h64, bloom = xxhash.xxh3_64_intdigest, bits and Bloom(0 + slots, bits.value)
        for batch in batches:
            digests: list[bytes] = []
            ids: list[int] = []
            keys: list[bytes] = []
            owner: list[int] = []
            for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)).to_pylist(), strict=True):
                own = {k for k in line_keys(text, min_chars)[1] if k is not None}
                keys += own
                owner += [doc] * len(own)
            h = np.array([h64(k) for k in keys], np.uint64)
            keep = bloom.has(h) if bloom else np.ones(len(keys), bool)
            for i in np.flatnonzero(keep):
                digests.append(_digest(keys[i]))
                ids.append(owner[i])
            arrays = [pa.array(digests, pa.binary()), pa.array(ids, pa.int64()), pa.array(h[keep].view(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, ["digest", "doc", "h"])

    found = docs.select(doc_key().alias("doc"), "text").mapInArrow(tidy(candidates), "digest binary, doc long, h long")
    if not small:
        found = found.join(suspects.distinct(), "h", "left_semi")
    found = scratch.write(found.select("digest", "doc"))
    scratch.drop(suspects)
    confirmed = scratch.write(
        found.distinct()
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("keeper"))
        .where(F.col("n") >= min_docs)
        .select("digest", "keeper")
    )
    fields = [
        T.StructField("text", T.StringType()),
        T.StructField("n_lines", T.LongType()),
        T.StructField("n_dropped", T.LongType()),
    ]

    def cut(text: bytes | None, gone) -> tuple[bytes, int, int]:
        lines, keys = line_keys(text, min_chars)
        kept = [line for line, k in zip(lines, keys, strict=True) if k is None or not gone(_digest(k))]
        return b"\n".join(kept), len(lines), len(lines) - len(kept)

    def arrays(made: list[tuple[bytes, int, int]]) -> dict[str, pa.Array]:
        text, n, gone = zip(*made, strict=True) if made else ((), (), ())
        return {"text": as_text(list(text)), "n_lines": pa.array(n, pa.int64()), "n_dropped": pa.array(gone, pa.int64())}

    if confirmed.count() <= max_table_rows:
        keepers = spark.sparkContext.broadcast({bytes(r.digest): r.keeper for r in confirmed.collect()})
        scratch.drop(found, confirmed)

        def make():
            keeper = keepers.value

            def fn(ids: pa.Array, texts: pa.Array) -> dict[str, pa.Array]:
                made = []
                for doc, text in zip(ids.to_pylist(), texts.to_pylist(), strict=True):
                    doc = -(2**63) if doc is None else doc
                    made.append(cut(text, lambda d, doc=doc: keeper.get(d, doc) != doc))
                return arrays(made)

            return fn

        return map_columns(docs, ["doc_id", "text"], fields, make)

    gone = found.join(confirmed, "digest").where("doc <> keeper").groupBy("doc").agg(F.collect_set("digest").alias("gone"))
    # Columns of the input keep out of the way: their names may be any.
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    marked = docs.select(row, doc_key().alias("doc")).join(gone, "doc", "left")
    clash, name = {c.lower() for c in docs.columns}, "__gone"
    while name in clash:
        name += "_"
    marked = marked.select("row.*", F.col("gone").alias(name))

    def make_joined():
        def fn(digests: pa.Array, texts: pa.Array) -> dict[str, pa.Array]:
            pairs = zip(digests.to_pylist(), texts.to_pylist(), strict=True)
            return arrays([cut(text, set(d or ()).__contains__) for d, text in pairs])

        return fn

    return map_columns(marked, [name, "text"], fields, make_joined).drop(name)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of ``documents``: lines, dropped lines and a digest of the text that stays."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, i,
         string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)
), keyed AS (
  SELECT doc_id, i, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), repeated AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT a.doc_id, a.i, a.line, r.k IS NOT NULL AND r.keeper <> a.doc_id AS gone
  FROM keyed a LEFT JOIN repeated r ON a.k = r.k
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
