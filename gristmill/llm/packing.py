"""Best-fit packing into bins of several permitted sequence lengths.

Token counts are dealt at random, by a hash, to shards of some tens of thousands
of pieces; each shard is packed as a whole by best-fit decreasing. A piece goes to
the open bin that it fills most; where none has room, a bin of the length that
costs least a token is opened, out of the permitted ones from a floor up. Every
permitted length is tried as the floor; afterwards each bin shrinks to the least
length that holds its contents, and the floor of the least total cost wins.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left, insort
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, doc_key, map_columns, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the byte-level vocabulary cuts text before merges: a fixed value of that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LENGTHS = (1024, 2048, 4096, 8192)
#: White space as that pattern sees it (Unicode's property), in runs too long for the encoder's search, which goes back step by step.
_LONG_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


def step_cost(length: int) -> float:
    """Of a sequence: its tokens, attention's square, and a fixed part."""
    return length * (1 + length / 16384) + 64


def pack(
    sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, cost: Callable[[int], float] = step_cost
) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing over ``sizes`` in falling order: each one's bin and offset, and each bin's final length.

    Sizes are 1 to the largest length. Of equally full bins the older one is
    taken; of floors that cost the same the least.
    """
    lengths = sorted(lengths)
    best = None
    least = sizes[-1] if len(sizes) else 0
    for floor in lengths:
        opens = {}  # by the least length that holds a piece: the length to open
        for c in lengths:
            opens[c] = min((x for x in lengths if x >= max(c, floor)), key=lambda x: (cost(x) / x, -x))
        room: list[tuple[int, int]] = []
        bins: list[int] = []
        offsets: list[int] = []
        used: list[int] = []
        for s in sizes:
            at = bisect_left(room, (s, -1))
            if at < len(room):
                left, b = room.pop(at)
            else:
                left, b = opens[lengths[bisect_left(lengths, s)]], len(used)
                used.append(0)
            bins.append(b)
            offsets.append(used[b])
            used[b] += s
            if left - s >= least:
                insort(room, (left - s, b))
        final = [lengths[bisect_left(lengths, u)] for u in used]
        total = sum(map(cost, final))
        if best is None or total < best[0]:
            best = total, bins, offsets, final
    return best[1], best[2], best[3]


def _encoder(lines: bytes) -> Callable[[str], list[int]]:
    """Token ids of a text of any length, as the vocabulary's own pattern cuts it.

    Very long runs of white space are cut off first: such a run is one piece of
    its own, but for its last character, which belongs with what follows.
    """
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
    encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    whole = tiktoken.Encoding("blank", pat_str=r"\s+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(text: str) -> list[int]:
        if len(text) < 4096:
            return encode(text)
        out, start = [], 0
        for run in _LONG_BLANK.finditer(text):
            end = run.end() - (run.end() < len(text))
            out += encode(text[start : run.start()])
            out += whole(text[run.start() : end])
            start = end
        return out + encode(text[start:]) if start else encode(text)

    return ids


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``docs`` (text, anything else) with ``n_tokens`` long: the text's tokens and one that ends the document.

    A null or empty text has the last one only. The vocabulary file is read on
    the driver; its size is fixed.
    """
    with open(tokenizer, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        encode = _encoder(sent.value)

        def fn(texts: pa.Array) -> dict[str, pa.Array]:
            n = [1 + (len(encode(t.decode())) if t else 0) for t in texts.to_pylist()]
            return {"n_tokens": pa.array(n, pa.int64())}

        return fn

    return map_columns(docs, ["text"], [T.StructField("n_tokens", T.LongType())], make)


def pack_documents(
    docs: DataFrame,
    lengths: Sequence[int] = LENGTHS,
    cost: Callable[[int], float] = step_cost,
    tokenizer: str = TOKENIZER,
    shard_pieces: int = 50_000,
) -> DataFrame:
    """One row a piece: doc_id, piece (from 0), start, n_tokens, bin_id, capacity, offset.

    ``docs``: doc_id, text. A document longer than the largest length is cut into
    pieces of that length and a rest; nothing is dropped. ``start`` is the piece's
    place in its document, ``offset`` its place in its bin, in tokens. Every
    document ends in one token of its own, so null and empty texts have one
    token. Rows that repeat are packed each; a null doc_id stays null. No rows
    give no rows. The result depends on the rows alone, not on how they are dealt.
    """
    scratch, most = Scratch(docs.sparkSession), max(lengths)
    counted = count_tokens(docs.select(doc_key().alias("doc"), F.xxhash64("text").alias("h"), "text"), tokenizer)
    pieces = scratch.write(
        counted.select("doc", "h", "n_tokens")
        .withColumn("piece", F.explode(F.expr(f"sequence(0L, (n_tokens - 1) div {most})")))
        .select("doc", "h", "piece", F.least(F.lit(most), F.col("n_tokens") - F.col("piece") * most).cast("long").alias("n"))
    )
    shards = max(1, -(-pieces.count() // shard_pieces))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc", "h", "piece", F.lit(7)), F.lit(shards)))

    def run(part):
        doc, h, piece, n = (part[c].to_numpy() for c in ("doc", "h", "piece", "n"))
        order = np.lexsort((h, piece, doc, -n))
        doc, piece, n = doc[order], piece[order], n[order]
        bins, offsets, final = pack(n.tolist(), lengths, cost)
        bins = np.array(bins, np.int64)
        shard = part["shard"][0].as_py()
        return pa.table(
            {
                "doc_id": pa.array(doc, mask=doc == -(2**63)),
                "piece": piece,
                "start": piece * most,
                "n_tokens": n,
                "bin_id": (shard << 32) + bins,
                "capacity": np.array(final, np.int64)[bins],
                "offset": np.array(offsets, np.int64),
            }
        )

    schema = "doc_id long, piece long, start long, n_tokens long, bin_id long, capacity long, offset long"
    return dealt.groupBy("shard").applyInArrow(run, schema)


def sequences(docs: DataFrame, placements: DataFrame, tokenizer: str = TOKENIZER, end: int = 50256) -> DataFrame:
    """The token ids of each bin: bin_id, capacity, tokens array<int> (contents only, pieces by offset).

    For documents of distinct doc_id that is not null; ``end`` closes each document.
    """
    with open(tokenizer, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    field = T.StructField("tokens", T.ArrayType(T.IntegerType()))

    def make():
        encode = _encoder(sent.value)

        def fn(texts: pa.Array) -> dict[str, pa.Array]:
            ids = [[*(encode(t.decode()) if t else ()), end] for t in texts.to_pylist()]
            return {"tokens": pa.array(ids, pa.list_(pa.int32()))}

        return fn

    ids = map_columns(docs.select("doc_id", "text"), ["text"], [field], make).drop("text")
    parts = placements.join(ids, "doc_id").select(
        "bin_id", "capacity", "offset", F.slice("tokens", F.col("start").cast("int") + 1, F.col("n_tokens").cast("int")).alias("ids")
    )
    rows = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return parts.groupBy("bin_id", "capacity").agg(F.flatten(F.transform(rows, lambda r: r.ids)).alias("tokens"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of ``documents``, placed in bins of 1,024 to 8,192 tokens."""
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
