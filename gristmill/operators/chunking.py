"""Structure-aware chunking: base spans that cover a text exactly, and chunks that overlap backwards.

The spans are packed greedily, each from where the last one ended, so a document
is one unit of work; documents go through Arrow batches, whole texts each.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import TERMINATORS

_PIECE = re.compile(rf"[^{TERMINATORS}]*[{TERMINATORS}]|[^{TERMINATORS}]+")


def sentences(text: str) -> list[str]:
    """As ``functions.text.sentences``."""
    out: list[str] = []
    for piece in filter(None, map(str.strip, _PIECE.findall(text.strip()))):
        if len(piece) < 4 and out:
            out[-1] += piece
        else:
            out.append(piece)
    return out


def blocks(text: str) -> list[tuple[str, int, int]]:
    """(heading in force, start, end) of stretches of lines; headings and blank lines part them and belong to none."""
    found: list[tuple[str, int, int]] = []
    heading, start, end, at = "", -1, 0, 0
    for line in text.splitlines(keepends=True):
        body = line.strip()
        if not body or body[0] == "#":
            if start >= 0:
                found.append((heading, start, end))
            start = -1
            if body:
                heading = body.lstrip("#").strip()
        else:
            start = at if start < 0 else start
            end = at + len(line)
        at += len(line)
    if start >= 0:
        found.append((heading, start, end))
    return found or [("", 0, len(text))]


def windows(start: int, end: int, limit: int) -> list[tuple[int, int]]:
    """Fixed-width cuts of a span."""
    return [(a, min(a + limit, end)) for a in range(start, max(end, start + 1), limit)]


def sentence_spans(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Where the sentences of a block stand. One that was joined from pieces isn't found; it starts where the last ended."""
    at = start
    for s in sentences(text[start:end]):
        found = text.find(s, at, end)
        first = at if found < 0 else found
        at = first + len(s)
        yield first, at
    if at < end:
        yield at, end


def base_spans(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Spans that cover the text without gaps: sentences packed up to ``size - overlap``, longer ones cut."""
    budget = max(1, size - max(0, overlap))
    packed: list[tuple[int, int]] = []
    held: tuple[int, int] | None = None
    for _, lo, hi in blocks(text):
        for s, e in sentence_spans(text, lo, hi):
            if held and e - s <= budget and e - held[0] <= budget:
                held = held[0], e
                continue
            if held:
                packed += windows(*held, budget)
            held = (s, e) if e - s <= budget else None
            if held is None:
                packed += windows(s, e, budget)
    if held:
        packed += windows(*held, budget)
    starts = [s for s, _ in packed]
    ends = [max(e, nxt) for (_, e), nxt in zip(packed, [*starts[1:], len(text)], strict=True)]
    return list(zip([0, *starts[1:]], ends, strict=True)) if packed else [(0, len(text))]


def chunk(text: str, size: int = 800, overlap: int = 120) -> Iterator[tuple[int, int, int, str, str]]:
    """(ordinal, start, end, heading, body): each base span with ``overlap`` characters before it; blank ones are left out."""
    if not text:
        return
    marks = blocks(text)
    starts, n = [b[1] for b in marks], 0
    for s, e in base_spans(text, size, overlap):
        body = text[max(0, s - max(0, overlap)) : e].strip()
        if body:
            yield n, s, e, marks[max(0, bisect_right(starts, s) - 1)][0], body
            n += 1


def stretches(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch (key, text) in stretches of whole rows of about ``most`` bytes of text, so that what is made of one stays small."""
    ends = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def chunk_documents(docs: DataFrame, size: int = 800, overlap: int = 120) -> DataFrame:
    """Chunks of ``docs`` (doc_id, text): chunk_id, doc_id, text, ordinal, heading, meta, start, end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in stretches(whole)):
            rows: list[list] = [[] for _ in range(6)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for values in chunk(text or "", size, overlap):
                    for column, v in zip(rows, (doc, *values), strict=True):
                        column.append(v)
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            names = ["doc_id", "ordinal", "start", "end", "heading", "text"]
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names)

    made = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(
        run, "doc_id string, ordinal int, start int, end int, heading string, text string"
    )
    return made.select(
        F.concat_ws("#", "doc_id", F.col("ordinal").cast("string")).alias("chunk_id"),
        "doc_id",
        "text",
        "ordinal",
        "heading",
        F.create_map().cast("map<string,string>").alias("meta"),
        "start",
        "end",
    )


class ChunkSpans:
    """UDTF for SQL: ``SELECT ... FROM docs, LATERAL chunk_spans(text, 800, 120)``."""

    def eval(self, text: str, size: int, overlap: int):
        yield from chunk(text or "", size, overlap)


def register(spark: SparkSession, name: str = "chunk_spans") -> None:
    from pyspark.sql.functions import udtf

    spark.udtf.register(name, udtf(ChunkSpans, returnType="ordinal int, start int, `end` int, heading string, text string"))


def hard_windows(docs: DataFrame, limit: int = 680) -> DataFrame:
    """(doc_id, start, end): fixed-width cuts of every text, as an expression."""
    cuts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("text") - 1), F.lit(limit))
    rows = docs.select("doc_id", F.length("text").alias("n"), F.explode(cuts).alias("start"))
    return rows.select("doc_id", "start", F.least(F.col("start") + limit, F.col("n")).alias("end"))
