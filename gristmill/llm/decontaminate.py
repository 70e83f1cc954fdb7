"""Benchmark decontamination: a generalised suffix automaton of the test items.

The automaton (over words) holds every run of words of every item. A document's
words stream through it; the state keeps the longest run that ends at the word
just read and is a run of some item. Where that run is as long as the window,
the window's words are hit. Items shorter than the window count as a whole.

Items are sent out in blocks of bounded size, one automaton at a time, so that
what a task holds does not grow with the benchmark.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORDS, Scratch, as_text, map_columns, table

_WORD = re.compile(rb"[^ ]+")
_built: dict[str, Automaton] = {}


class Automaton:
    """Generalised suffix automaton of the items' words; ``window`` words make a hit."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.len = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        n = len(self.len)
        #: The state that holds the last ``window`` words of a state's runs, and the items of each such state.
        self.at = [0] * n
        self.items: dict[int, set[str]] = {}
        #: Whole items shorter than the window that are a suffix of a state's runs, as (words, item).
        self.short: list[list[tuple[int, str]]] = [[] for _ in range(n)]
        order = sorted(range(1, n), key=self.len.__getitem__)
        for s in order:
            up = self.link[s]
            if self.len[s] >= window:
                self.at[s] = s if self.len[up] < window else self.at[up]
        for item, words in items:
            s = 0
            for i, w in enumerate(words, 1):
                s = self.next[s][w]
                if i >= window:
                    self.items.setdefault(self.at[s], set()).add(item)
            if 0 < len(words) < window:
                self.short[s].append((len(words), item))
        for s in order:
            self.short[s] += self.short[self.link[s]]

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.len
        q = nxt[last].get(w)
        if q is not None and length[q] == length[last] + 1:
            return q
        if q is None:
            new = self._state(length[last] + 1, {}, 0)
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, w)
            return new
        return self._clone(last, q, w)

    def _clone(self, p: int, q: int, w: bytes) -> int:
        copy = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _state(self, length: int, nxt: dict, link: int) -> int:
        self.next.append(nxt)
        self.len.append(length)
        self.link.append(link)
        return len(self.len) - 1

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Spans of hit words, in order and apart, as [first, end), and the items that were met."""
        nxt, link, length, window, short = self.next, self.link, self.len, self.window, self.short
        s = run = 0
        spans: list[list[int]] = []
        met: set[str] = set()
        for i, w in enumerate(words):
            t = nxt[s].get(w)
            while t is None and s:
                s = link[s]
                run = length[s]
                t = nxt[s].get(w)
            if t is None:
                continue
            s = t
            run += 1
            first = -1
            if run >= window:
                first = i + 1 - window
                met |= self.items[self.at[s]]
            if short[s]:
                own = [(n, item) for n, item in short[s] if n <= run]
                met.update(item for _, item in own)
                if first < 0 and own:
                    first = i + 1 - max(n for n, _ in own)
            if first >= 0:
                while spans and spans[-1][0] >= first:
                    spans.pop()
                if spans and spans[-1][1] >= first:
                    spans[-1][1] = i + 1
                else:
                    spans.append([first, i + 1])
        return spans, met


def words_of(text: bytes | None) -> list[bytes]:
    """Words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased."""
    return (text or b"").translate(WORDS).split()


def _merge(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _blocks(items: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The items (id, text) in blocks of about ``block_bytes`` each."""
    rows = items.select(F.col("item_id").cast("string").alias("id"), "text").where("text IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    return [rows if n == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b) for b in range(n)]


def find_hits(
    docs: DataFrame, items: DataFrame, window: int = 10, block_bytes: int = 4 << 20, prefix: str = "", cut: bool = False
) -> DataFrame:
    """``docs`` (text, anything else) with ``n_words`` long, ``hit_spans`` array<array<long>> and ``hit_items`` array<string>.

    ``items``: item_id, text. Spans are [first, end) of words, merged where they
    touch or overlap; items are sorted as strings. A null or empty text has no
    words; items of null text or no words are not looked for; items that repeat count
    once. What items of null id say is hit like others', but they have no name to list. Columns of those three names (after ``prefix``) are
    replaced. ``cut``: ``text`` loses the words of its spans.
    """
    n_words, hit_spans, hit_items = (prefix + c for c in ("n_words", "hit_spans", "hit_items"))
    scratch = Scratch(docs.sparkSession)
    spans, names = T.ArrayType(T.ArrayType(T.LongType())), T.ArrayType(T.StringType())
    fields = [T.StructField(n_words, T.LongType()), T.StructField(hit_spans, spans), T.StructField(hit_items, names)]
    out, held = docs, None
    blocks = _blocks(items, block_bytes)
    for no, block in enumerate(blocks):
        if no:  # one automaton a task at a time
            kept, held = held, scratch.write(out)
            if kept is not None:
                scratch.drop(kept)
            out = held
        # A block is of bounded size.
        sent = docs.sparkSession.sparkContext.broadcast([(r.id, r.text.encode()) for r in block.toLocalIterator()])
        token, first, last = uuid.uuid4().hex, not no, no == len(blocks) - 1

        def make(sent=sent, token=token, first=first, last=last):
            if token not in _built:
                _built.clear()
                _built[token] = Automaton([(i, words_of(t)) for i, t in sent.value], window)
            scan = _built[token].scan

            def fn(texts: pa.Array, *before: pa.Array) -> dict[str, pa.Array]:
                n, found, met, left = [], [], [], []
                old = zip(*(c.to_pylist() for c in before), strict=True) if before else (((), ()) for _ in range(len(texts)))
                for text, (s0, m0) in zip(texts.to_pylist(), old, strict=True):
                    words = words_of(text)
                    s, m = scan(words)
                    n.append(len(words))
                    found.append(s if first else _merge([*s0, *s]))
                    met.append(sorted(x for x in m.union(x if isinstance(x, str) else x.decode() for x in m0) if x is not None))
                    if cut and last:
                        left.append(cut_spans(text, found[-1]))
                return {
                    n_words: pa.array(n, pa.int64()),
                    hit_spans: pa.array(found, pa.list_(pa.list_(pa.int64()))),
                    hit_items: pa.array(met, pa.list_(pa.string())),
                    **({"text": as_text(left)} if cut and last else {}),
                }

            return fn

        made = [*fields, T.StructField("text", T.StringType())] if cut and last else fields
        out = map_columns(out, ["text"] if first else ["text", hit_spans, hit_items], made, make)
    return out


def n_hit(prefix: str = ""):
    return F.aggregate(prefix + "hit_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])


def cut_spans(text: bytes | None, spans: list[list[int]]) -> bytes | None:
    """``text`` less the words of ``spans`` and what stands between them."""
    if not spans or text is None:
        return text
    at = [m.span() for m in _WORD.finditer(text.translate(WORDS))]
    out, end = [], 0
    for a, b in spans:
        out.append(text[end : at[a][0]])
        end = at[b - 1][1]
    return b"".join([*out, text[end:]])


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.5, block_bytes: int = 4 << 20
) -> DataFrame:
    """``docs`` less the spans that items hold, and less the documents of which that is too much.

    A span is every word inside an occurrence of ``window`` consecutive item
    words (or of a whole shorter item). A document of which more than
    ``max_coverage`` of the words are hit goes; the others lose their spans. The
    columns are those of ``docs``, whatever their names, and only text and n_chars,
    where there is one, change: n_chars follows the text.
    """
    own, clash = docs.columns, {c.lower() for c in docs.columns}
    prefix = "__"
    while any((prefix + c) in clash for c in ("n_words", "hit_spans", "hit_items")):
        prefix += "_"
    found = find_hits(docs, items, window, block_bytes, prefix, cut=True)
    kept = found.where(n_hit(prefix) <= max_coverage * F.col(prefix + "n_words"))
    length = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")} if "n_chars" in own else {}
    return kept.select(*(length.get(c, F.col(f"`{c}`")) for c in own))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of ``documents``: words, words hit by ``benchmark``, and the items met."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_hits(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n,
         unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS g
  FROM b WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, sizes WHERE len(w) >= n
), hits AS (
  SELECT g.doc_id, g.i, g.n, x.item_id FROM grams g JOIN windows x
  ON g.n = x.n AND array_to_string(g.w[g.i:g.i + g.n - 1], ' ') = x.g
), words AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id
), met AS (
  SELECT doc_id, count(id) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(words.n_hit, 0) AS n_hit, coalesce(met.n_items, 0) AS n_items,
       sha256(coalesce(met.ids, '')) AS items_sha256, words.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN met ON met.doc_id = d.doc_id
"""
