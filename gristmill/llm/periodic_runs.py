"""Periodic runs of words by the runs theorem.

Every run's period is that of a Lyndon word, its root, which for one of the two
orders of the alphabet is the longest Lyndon word at its start. So a text has fewer
runs than two for each word, and all of them come from two candidates a place: the
stretch up to the next smaller value, and up to the next greater one, in the inverse
suffix array. A candidate is extended to both sides by longest common prefixes, which
are minima of ranges of the LCP array (of the text, and of its reverse), taken from a
sparse table.

A run here has at least six words and four periods, so every five words in a row
within it stand in the text again. Only stretches of such words go to the suffix
array; what lies between them holds no part of a run.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from hashlib import sha256
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import as_bytes, map_columns, slices, table

LEAST, TIMES, GRAM = 6, 4, 5
_STEP = np.uint64(0x9E3779B97F4A7C15)


def suffix_ranks(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, its inverse and the LCP array (of each suffix and the one before it) of ``s``, by doubling.

    The last value must occur once.
    """
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    levels, h = [rank.astype(np.int32)], 1
    while True:
        key = rank * (n + 1)
        key[: n - h] += rank[h:] + 1
        order = np.argsort(key, kind="stable")
        own = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(own[1:] != own[:-1])))
        if rank[order[-1]] == n - 1:
            break
        levels.append(rank.astype(np.int32))
        h *= 2
    lcp = np.zeros(n, np.int32)
    a, b = order[1:].copy(), order[:-1].copy()
    own = lcp[1:]
    for level in range(len(levels) - 1, -1, -1):
        same = np.flatnonzero((a < n) & (b < n))
        same = same[levels[level][a[same]] == levels[level][b[same]]]
        own[same] += 1 << level
        a[same] += 1 << level
        b[same] += 1 << level
    return order, rank, lcp


class CommonPrefixes:
    """Longest common prefixes of any two suffixes: least values of ranges of the LCP array, by a sparse table."""

    def __init__(self, rank: np.ndarray, lcp: np.ndarray):
        self.rank, self.table = rank, [lcp]
        while 2 << len(self.table) - 1 <= len(lcp):
            last, half = self.table[-1], 1 << len(self.table) - 1
            self.table.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of the suffixes at ``i`` and ``j``, which differ."""
        a, b = self.rank[i], self.rank[j]
        a, b = np.minimum(a, b) + 1, np.maximum(a, b) + 1  # the least of lcp[a:b]
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            own = level == k
            out[own] = np.minimum(self.table[k][a[own]], self.table[k][b[own] - (1 << int(k))])
        return out


def next_smaller(values: list[int]) -> list[int]:
    """For each place the next one with a smaller value; the length where there is none."""
    n = len(values)
    out = [n] * n
    for i in range(n - 2, -1, -1):
        v, j = values[i], i + 1
        while j < n and values[j] > v:
            j = out[j]
        out[i] = j
    return out


def runs_of(s: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs in the stretches of ``s``; each stretch ends before an edge, a value that occurs once."""
    n = len(s)
    _, rank, lcp = suffix_ranks(s)
    ahead = CommonPrefixes(rank, lcp)
    values = rank.tolist()
    i = np.tile(np.arange(n), 2)
    j = np.concatenate([next_smaller(values), next_smaller([-v for v in values])])
    end = edges[np.searchsorted(edges, i)]
    first = np.concatenate(([0], edges[:-1] + 1))[np.searchsorted(edges, i)]
    fits = (j < end) & ((j - i) * TIMES <= end - first)
    i, j = i[fits], j[fits]
    same = s[i] == s[j]  # a root that is not repeated to the right is repeated to the left; another of the run's roots is then to the right
    i, j = i[same], j[same]
    if not len(i):
        return (np.empty(0, np.int64),) * 3
    right = ahead(i, j)
    q = j - i
    wide = right >= q  # the run's first root reaches two more periods
    i, j, q, right = i[wide], j[wide], q[wide], right[wide]
    # Backwards: the text reversed, up to the edge before a stretch, which stands last.
    back = np.concatenate((s[:-1][::-1], s[-1:]))
    _, rank, lcp = suffix_ranks(back)
    behind = CommonPrefixes(rank, lcp)
    left, inner = np.zeros(len(i), np.int64), np.flatnonzero(i > 0)
    left[inner] = behind(n - 1 - i[inner], n - 1 - j[inner])
    start, length = i - left, left + q + right
    long = (length >= LEAST) & (length >= TIMES * q)
    found = np.unique(np.stack([start[long], q[long], length[long]], 1), axis=0)
    return found[:, 0], found[:, 2], found[:, 1]


def _stretches(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which words are part of five in a row that their text has again."""
    n = len(words) - GRAM + 1
    if n < 2:
        return np.zeros(len(words), bool)
    h = text[:n].astype(np.uint64)
    for k in range(GRAM):
        h = (h ^ words[k : k + n].astype(np.uint64)) * _STEP
        h ^= h >> np.uint64(29)
    whole = np.flatnonzero(text[:n] == text[GRAM - 1 :])
    if not len(whole):
        return np.zeros(len(words), bool)
    order = np.argsort(h[whole], kind="stable")
    own = h[whole][order]
    same = own[1:] == own[:-1]
    again = whole[order[np.concatenate((same, [False])) | np.concatenate(([False], same))]]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + GRAM, -1)
    return np.cumsum(edge[:-1]) > 0


def find_runs(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, length, period) of all runs in ``words``, numbers of words; ``text``: the number of the text of each, ascending."""
    held = np.flatnonzero(_stretches(words, text))
    if not len(held):
        return (np.empty(0, np.int64),) * 3
    ends = np.flatnonzero(np.concatenate((np.diff(held) != 1, [True])) | np.concatenate((np.diff(text[held]) != 0, [True])))
    sizes = np.diff(np.concatenate(([-1], ends)))
    keep = sizes >= LEAST
    held, sizes = held[np.repeat(keep, sizes)], sizes[keep]
    if not len(sizes):
        return (np.empty(0, np.int64),) * 3
    # Each stretch, then an edge: a number that no word has and no other edge.
    edges = np.cumsum(sizes + 1) - 1
    s = np.empty(len(held) + len(sizes), np.int64)
    inner = np.ones(len(s), bool)
    inner[edges] = False
    s[inner], s[edges] = words[held], int(words.max()) + 1 + np.arange(len(sizes))
    at = np.zeros(len(s), np.int64)
    at[inner] = held
    start, length, period = runs_of(s, edges)
    return at[start], length, period


def _altered(n: int, doc_id) -> tuple[int, int] | None:
    """(a, p): words from the a-th on repeat the p words there, in a tenth of the documents."""
    if doc_id is None or not n:
        return None
    h = crc32(str(doc_id).encode())
    a, g = (h // 10) % n, h // 10
    return (a, 1 + (n - a) // (3 + g % 8)) if h % 10 == 0 else None


FIELDS = [
    T.StructField("n_runs", T.LongType()),
    *(T.StructField(n, T.LongType()) for n in ("start", "length", "period", "exponent_milli")),
    T.StructField("runs_sha256", T.StringType()),
    T.StructField("collapsed_sha256", T.StringType()),
    T.StructField("runs", T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))),
    T.StructField("collapsed", T.StringType()),
]


def _finder(alter: bool, digests: bool):
    def one(ids: list, texts: list[bytes]) -> dict[str, list]:
        number: dict[bytes, int] = defaultdict(count().__next__)
        split, codes = [], []
        for doc_id, text in zip(ids, texts, strict=True):
            own = (text or b"").split()
            code = np.fromiter(map(number.__getitem__, own), np.int64, len(own))
            change = _altered(len(own), doc_id) if alter else None
            if change:
                a, p = change
                at = np.arange(len(own))
                at[a:] = a + (at[a:] - a) % p
                code, own = code[at], [own[i] for i in at.tolist()]
            split.append(own)
            codes.append(code)
        sizes = np.array([len(x) for x in split])
        first = np.concatenate(([0], np.cumsum(sizes)))
        words = np.concatenate([*codes, np.empty(0, np.int64)])
        place, length, period = find_runs(words, np.repeat(np.arange(len(split)), sizes))
        bounds = np.searchsorted(place, first)
        out: dict[str, list] = {f.name: [] for f in FIELDS}
        for i, own in enumerate(split):
            a, b = bounds[i], bounds[i + 1]
            runs = list(zip((place[a:b] - first[i]).tolist(), length[a:b].tolist(), period[a:b].tolist(), strict=True))
            if runs:
                ratio = length[a:b] / period[a:b]
                near = [runs[k] for k in np.flatnonzero(ratio >= ratio.max() * (1 - 1e-12))]
                top = max(near, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
                dropped = np.zeros(len(own) + 1, np.int64)
                np.add.at(dropped, place[a:b] - first[i] + period[a:b], 1)
                np.add.at(dropped, place[a:b] - first[i] + length[a:b], -1)
                own = [w for w, d in zip(own, np.cumsum(dropped).tolist(), strict=False) if not d]
            else:
                top = None
            kept = b" ".join(own)
            out["n_runs"].append(len(runs))
            for n, v in zip(("start", "length", "period", "exponent_milli"), (*top, 1000 * top[1] // top[2]) if top else (None,) * 4, strict=True):
                out[n].append(v)
            if digests:
                out["runs_sha256"].append(sha256(b"".join(b"%d,%d,%d\n" % r for r in runs)).hexdigest())
                out["collapsed_sha256"].append(sha256(kept).hexdigest())
            else:
                out["runs"].append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                out["collapsed"].append(kept.decode("utf-8", "replace"))
        return out

    return one


def _map(docs: DataFrame, reads: list[str], fields: list[T.StructField], one) -> DataFrame:
    kinds = {"long": pa.int64(), "bigint": pa.int64(), "string": pa.string()}
    spans = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def make():
        def run(*columns: pa.Array) -> dict[str, pa.Array]:
            batch = pa.RecordBatch.from_arrays(list(columns), [str(i) for i in range(len(columns))])
            parts: dict[str, list] = {f.name: [] for f in fields}
            for part in slices(batch, 256, 4 << 20):
                texts = as_bytes(part.column(0)).to_pylist()
                ids = part.column(1).to_pylist() if len(columns) > 1 else [None] * len(texts)
                found = one(ids, texts)
                for name in parts:
                    parts[name] += found[name]
            return {f.name: pa.array(parts[f.name], kinds.get(f.dataType.simpleString(), spans)) for f in fields}

        return run

    return map_columns(docs, reads, fields, make)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``docs`` (text) with n_runs, start, length, period, exponent_milli, ``runs`` and ``collapsed``.

    Words are runs of characters but the six ASCII blanks, numbered from 0; a null text
    has none. A run is a stretch of at least six words and four of its smallest period
    that can't be extended; ``runs`` has them by start, then period. start, length,
    period and exponent_milli (1000 times length by period, rounded down) are those of
    the run of greatest length by period, of ties the first by start, then period; null
    where there is none. ``collapsed``: the words that no run holds beyond its first
    period, joined by one space. A text is one task's work, its repeated stretches some
    300 bytes a word. Rows that repeat have a row each; every other column passes
    through, unless it has one of these names.
    """
    return _map(docs, ["text"], [f for f in FIELDS if not f.name.endswith("sha256")], _finder(False, False))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of ``documents``, a tenth of them made periodic: its runs and what is left without their repeats."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fields = [f for f in FIELDS if f.name not in ("runs", "collapsed")]
    return _map(docs, ["text", "doc_id"], fields, _finder(True, True)).drop("text")
