"""N-gram Jaccard join: universe partition and pigeonhole, verified exactly.

A document is the set of its word shingles, hashed to 64 bits; equal sets are one
node. For pairs of sets of which the smaller falls in size band b, the universe of
hashes is cut into m_b = H_b + 1 segments, where H_b bounds the symmetric
difference of any such pair that links. Some segment must then be equal in both.
Each set indexes the hash of every segment that is worth it. An empty segment is
not, nor is one whose only shingle is frequent: too many sets share it. What w such
weak segments leave open goes to one-deletion neighbourhoods: of the segments up to
the w-th that has three shingles or more, each also indexes its hashes less one
shingle. (If no worthwhile segment is equal, at most w segments are, and every other
one differs; so fewer differences are left over than there are such segments, and one
of them differs by a single shingle and keeps two or more in common.) Which shingles
count as frequent, found on a share of the sets, decides the cost only.

Sets that share an index entry are candidates, less the pairs whose sizes or count
sketches rule a link out. A star from the least set of each entry's group is
verified first. Groups that this leaves in several components are taken up again:
of their pairs across components that pass the same bounds a spanning forest is
kept, and within each tree of all these forests the pairs that pass are verified on
the sets themselves, until the tree is one component or all are done. Large groups
meet in cells of two parts each. So no link that can join two components is lost, and
pairs are never listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, Scratch, as_bytes, doc_key, slices, table, tidy
from .components import components

#: A sketch has at least so many buckets, and of large sets one for two to four shingles.
BUCKETS = 256
#: What meets in one cell is twice as much, about: nodes by their sketches, and bytes of sets.
CELL, SET_CELL = 1024, 2 << 20
#: Of one in so many sets the shingles are counted; those of so many of these are frequent; so many at most are sent out.
COUNTED_SHARE, FREQUENT, MOST_FREQUENT = 50, 4, 200_000
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_RATIO = 1.5


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


class _Words(dict):
    """Hashes of words, made when first asked for."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """The sorted distinct hashes of a text's shingles; word hashes are kept from text to text, within a bound."""

    def __init__(self, words: int, kept: int = 60_000):
        self.words, self.kept, self.seen = words, kept, _Words()
        self.by = [np.uint64(pow(int(_M2), i + 1, 1 << 64)) for i in range(words)]

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").translate(LOWER).split()
        if not words:
            return np.empty(0, np.uint64)
        if len(self.seen) > self.kept:
            self.seen.clear()
        h = np.fromiter(map(self.seen.__getitem__, words), np.uint64, len(words))
        width = min(len(h), self.words)
        n = len(h) - width + 1
        out = h[:n] * self.by[0]
        for i in range(1, width):
            out += h[i : n + i] * self.by[i]
        out = mix(out + np.uint64(width))
        out.sort()
        return out[np.concatenate(([True], out[1:] != out[:-1]))]


def sketch(h: np.ndarray) -> bytes:
    """Counts by bucket, modulo 16, two a byte; their circular L1 distance never exceeds the symmetric difference."""
    size = max(BUCKETS, 1 << max(0, (len(h) // 2).bit_length() - 1))
    counts = np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 15
    return (counts[::2] << 4 | counts[1::2]).tobytes()


class Sketches:
    """Sketches of a batch, unpacked; those of twice the size are folded where a pair needs it."""

    def __init__(self, packed: list[bytes]):
        sizes = np.array([2 * len(x) for x in packed], np.int64)
        self.size, self.row, self.counts = sizes, {}, {}
        own = {}
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            two = np.frombuffer(b"".join([packed[i] for i in at.tolist()]), np.uint8).reshape(len(at), size // 2)
            own[size] = at, np.stack([two >> 4, two & 15], axis=2).reshape(len(at), size)
        for size, (at, counts) in own.items():
            more, larger = own.get(2 * size, (at[:0], np.empty((0, 2 * size), np.uint8)))
            row = np.full(len(packed), -1)
            row[np.concatenate([at, more])] = np.arange(len(at) + len(more))
            self.row[size] = row
            self.counts[size] = np.concatenate([counts, (larger[:, :size] + larger[:, size:]) & 15])

    def near(self, i: np.ndarray, j: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
        """Whether pairs (i, j) of sets of ``n`` shingles may link, by their sizes and sketches."""
        small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        total = small + large
        most = total - 2 * -(-percent * total // (100 + percent))
        out = 100 * small >= percent * large
        least, wide = np.minimum(self.size[i], self.size[j]), np.maximum(self.size[i], self.size[j])
        for size in np.unique(least[out]).tolist():
            at = np.flatnonzero(out & (least == size) & (wide <= 2 * size))
            row, counts = self.row[size], self.counts[size]
            for part in np.array_split(at, 1 + len(at) * size // (4 << 20)):
                d = (counts[row[i[part]]] - counts[row[j[part]]]) & 15
                out[part] = np.minimum(d, 16 - d).sum(axis=1, dtype=np.int64) <= most[part]
        return out


def set_id(h: np.ndarray) -> int:
    return int(np.frombuffer(xxhash.xxh3_64_digest(h.tobytes()), ">i8")[0])


def _bands(percent: int) -> tuple[list[int], list[int]]:
    """Upper sizes of the bands, and each one's number of segments: one more than linked sets may differ in."""
    uppers = [1]
    while uppers[-1] < 1 << 40:
        uppers.append(max(uppers[-1] + 1, int(uppers[-1] * _RATIO)))
    most = lambda t: t - 2 * -(-percent * t // (100 + percent))  # noqa: E731  rises or falls by one a step
    return uppers, [max(most(t), most(t - 1)) + 1 for t in (u + u * 100 // percent for u in uppers)]


@cache
def bands(percent: int) -> tuple[np.ndarray, list[int]]:
    uppers, segments = _bands(percent)
    return np.array(uppers), segments


@cache
def _bounds(m: int) -> np.ndarray:
    return np.array([(i << 64) // m for i in range(1, m)], np.uint64)


_NONE = np.empty(0, np.uint64)


def entries(h: np.ndarray, percent: int, frequent: np.ndarray = _NONE) -> np.ndarray:
    """The index entries of a set (sorted distinct hashes): hashes of (band, segment, shingles); ``frequent`` is sorted."""
    n = len(h)
    if not n:
        return _NONE
    uppers, segments = bands(percent)
    own = int(np.searchsorted(uppers, n))
    common = np.zeros(n, bool)
    if len(frequent):
        common = frequent[np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)] == h
    out = []
    # As the smaller set of a pair, and as the larger one of a pair whose smaller set is in a lower band.
    for band in range(int(np.searchsorted(uppers, -(-percent * n // 100))), own + 1):
        m = segments[band]
        tagged = mix(h + np.uint64((band * 2 + 1) * int(_STEP) % (1 << 64)))
        ends = np.concatenate(([0], np.searchsorted(h, _bounds(m)), [n]))
        sizes = np.diff(ends)
        total = np.concatenate(([np.uint64(0)], np.cumsum(tagged, dtype=np.uint64)))
        sums = total[ends[1:]] - total[ends[:-1]]
        label = mix(np.arange(1, m + 1, dtype=np.uint64) * _M2 + np.uint64(band))
        weak = (sizes == 0) | (sizes == 1) & common[np.minimum(ends[:-1], n - 1)]
        need = int(weak.sum())
        solid = np.cumsum(sizes >= 3)
        upto = int(np.searchsorted(solid, need)) + 1 if need else 0
        if need and solid[-1] < need:  # too few to make up for the weak: plain pigeonhole, empty segments and all
            weak[:], upto = False, m
        out.append(mix(sums[~weak] + label[~weak]))
        if upto:
            # The sum of a segment less one shingle equals the full sum of a set without it.
            seg = np.flatnonzero(sizes[:upto] >= 2)
            if len(seg):
                at = np.concatenate([np.arange(ends[x], ends[x + 1]) for x in seg])
                seg = np.repeat(seg, sizes[seg])
                out.append(mix(sums[seg] - tagged[at] + label[seg]))
    return np.unique(np.concatenate(out))


def members(docs: DataFrame, words: int) -> DataFrame:
    """doc (null id: below all), h (of the text), n, node (null: no shingles), sketch (of a node's first row in a batch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for batch in batches:
            n, node, drawn, done = [], [], [], set()
            for text in as_bytes(batch.column(2)).to_pylist():
                h = shingle(text)
                own = set_id(h) if len(h) else None
                n.append(len(h))
                node.append(own)
                drawn.append(None if own is None or own in done else sketch(h))
                done.add(own)
            made = [pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(drawn, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], ["doc", "h", "n", "node", "sketch"])

    rows = docs.select(doc_key().alias("doc"), F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(tidy(run), "doc long, h long, n long, node long, sketch binary")


def _frequent(docs: DataFrame, reps: DataFrame, words: int, scratch: Scratch) -> np.ndarray:
    """Shingles that many of a share of the sets hold, sorted; a bounded number of them, the most frequent first."""
    some = reps.select("node").where(F.pmod(F.xxhash64(F.lit("share"), "node"), F.lit(COUNTED_SHARE)) == 0)
    sets = _sets(docs, reps, some, words, scratch).dropDuplicates(["node"])
    counted = sets.select(F.explode("h").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    most = counted.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "shingle").limit(MOST_FREQUENT)
    return np.sort(np.array([r.shingle for r in most.select("shingle").collect()], np.int64).view(np.uint64))


def _index(docs: DataFrame, words: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """(entry, node), each set once a task."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, done, common = Shingler(words), set(), sent.value
        for batch in batches:
            for part in slices(batch, 256, 1 << 20):
                keys, nodes = [], []
                for text in as_bytes(part.column(0)).to_pylist():
                    h = shingle(text)
                    node = set_id(h) if len(h) else None
                    if node is None or node in done:
                        continue
                    if len(done) > 50_000:
                        done.clear()
                    done.add(node)
                    keys.append(e := entries(h, percent, common))
                    nodes.append(np.full(len(e), node, np.int64))
                if keys:
                    arrays = [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes))]
                    yield pa.RecordBatch.from_arrays(arrays, ["entry", "node"])

    return docs.select("text").mapInArrow(tidy(run), "entry long, node long")


def _stars(index: DataFrame) -> DataFrame:
    """(entry, hub, node) for each entry that several nodes share; streams through sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = last_hub = last_node = None
        for batch in batches:
            key, node = (batch.column(i).to_numpy() for i in (0, 1))
            if not len(key):
                continue
            new = np.concatenate(([key[0] != last_key], key[1:] != key[:-1]))
            starts = np.flatnonzero(new)
            hub = np.empty_like(node)
            group = np.cumsum(new) - 1
            hub[group >= 0] = node[starts][group[group >= 0]] if len(starts) else 0
            hub[group < 0] = last_hub if last_hub is not None else 0
            before = np.concatenate(([node[0] if last_node is None else last_node], node[:-1]))
            keep = ~new & (node != hub) & (node != before)
            last_key, last_hub, last_node = key[-1], hub[-1], node[-1]
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, hub, node)], ["entry", "hub", "node"])

    dealt = index.repartition(F.col("entry")).sortWithinPartitions("entry", "node")
    return dealt.mapInArrow(tidy(run), "entry long, hub long, node long")


def _sets(docs: DataFrame, reps: DataFrame, nodes: DataFrame, words: int, scratch: Scratch) -> DataFrame:
    """(node, h) of ``nodes``: their sets, made anew from the text of one document each."""
    wanted = scratch.write(reps.join(nodes, "node", "left_semi").select("doc", "node"))
    texts = docs.select(doc_key().alias("doc"), "text")
    texts = texts.join(F.broadcast(wanted) if wanted.count() <= 500_000 else wanted, "doc")  # 16 bytes each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for batch in batches:
            for part in slices(batch, 128, 1 << 20):
                sets, nodes = [], []
                for text, node in zip(as_bytes(part.column(0)).to_pylist(), part.column(1).to_pylist(), strict=True):
                    h = shingle(text)
                    if len(h) and set_id(h) == node:  # a doc_id may stand on several rows
                        sets.append(h.view(np.int64))
                        nodes.append(node)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "h"])

    return texts.select("text", "node").mapInArrow(tidy(run), "node long, h array<long>")


def _near(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b, shared) less those that the length and sketch bounds rule out: no link is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4096, 1 << 20):
                rows = part.num_rows
                drawn = Sketches([*part.column(4).to_pylist(), *part.column(6).to_pylist()])
                n = np.concatenate([part.column(3).to_numpy(), part.column(5).to_numpy()])
                keep = pa.array(drawn.near(np.arange(rows), np.arange(rows, 2 * rows), n, percent))
                yield pa.RecordBatch.from_arrays([part.column(i).filter(keep) for i in range(3)], ["a", "b", "shared"])

    for name, n, drawn in (("a", "n", "c"), ("b", "m", "d")):
        own = reps.select(F.col("node").alias(name), F.col("n").alias(n), F.col("sketch").alias(drawn))
        pairs = pairs.join(own, name)
    return pairs.select("a", "b", "shared", "n", "c", "m", "d").mapInArrow(tidy(run), "a long, b long, shared long")


def _verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """``pairs`` (a, b) with ``linked``."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = scratch.write(_sets(docs, reps, ends, words, scratch).dropDuplicates(["node"]))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = batch.columns
            linked = []
            for i in range(batch.num_rows):
                linked.append(_linked(x[i].values.to_numpy(), y[i].values.to_numpy(), percent))
            yield pa.RecordBatch.from_arrays([a, b, pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    joined = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("h").alias("x")), "a")
    joined = joined.join(sets.select(F.col("node").alias("b"), F.col("h").alias("y")), "b").select("a", "b", "x", "y")
    checked = scratch.write(joined.mapInArrow(tidy(check), "a long, b long, linked boolean"))
    scratch.drop(sets)
    return checked


def _cells(rest: DataFrame, cell: int) -> DataFrame:
    """``rest`` (entry, node, size (of the entry, in what ``cell`` is), anything else) dealt to cells (entry, lo, hi) of two parts of an entry's nodes each, with ``part``.

    Each pair of parts has a cell, so each pair of nodes meets; an entry of up to
    ``cell`` is one cell.
    """
    parts = F.ceil(F.col("size") / cell).cast("int")
    part = F.pmod(F.xxhash64(F.lit("part"), "node"), parts).cast("int")
    dealt = rest.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other")).drop("other")


def _by_cell(batches: Iterator[pa.RecordBatch], least: int, size: int = 4 << 20) -> Iterator[pa.Table]:
    """Rows sorted by (entry, lo, hi) as tables of whole cells, of ``least`` rows or ``size`` bytes or more where there are as many."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        rows = pa.Table.from_batches(held)
        if rows.num_rows < least and rows.nbytes < size:
            continue
        keys = [rows[c].to_numpy() for c in ("entry", "lo", "hi")]
        other = np.flatnonzero(np.any([x != x[-1] for x in keys], axis=0))
        if len(other):  # the last cell may go on
            cut = int(other[-1]) + 1
            yield rows.slice(0, cut)
            held = rows.slice(cut).combine_chunks().to_batches()
    if held and (rows := pa.Table.from_batches(held)).num_rows:
        yield rows


class _Joined:
    """Union-find over rows that begin in components."""

    def __init__(self, component: np.ndarray):
        self.up = np.unique(component, return_inverse=True)[1].tolist()
        self.own = self.up[:]
        self.up = list(range(max(self.own, default=-1) + 1))

    def root(self, i: int) -> int:
        i = self.own[i]
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _forest(cells: DataFrame, percent: int, exact: bool) -> DataFrame:
    """(a, b): of each cell pairs across components, as few as join what all of them join. Streams through sorted rows.

    A pair counts that the length and sketch bounds let pass or, if ``exact``, one whose
    sets (``h``) are near enough; then what is in a component is joined from the start.
    """
    names = ["entry", "lo", "hi", "part", "node", "component", "n", "sketch", *(["h"] if exact else [])]

    def pairs(rows: pa.Table) -> tuple[list[int], list[int]]:
        entry, lo, hi, part, node, comp, n = (rows[c].to_numpy() for c in names[:7])
        drawn = Sketches(rows["sketch"].to_pylist())
        sets = rows["h"].combine_chunks() if exact else None
        new = (entry[1:] != entry[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        group = np.concatenate(([0], np.cumsum(new)))
        # A possible pair says nothing of others in the same components; a link does, within the cell.
        joined = _Joined(np.unique(np.stack([group, comp]), axis=1, return_inverse=True)[1].ravel() if exact else np.arange(len(node)))
        a, b, held, k, here = [], [], [], 1, np.arange(len(node) - 1)
        while len(here):  # rows k apart of one cell; these are sorted by n
            here = here[here + k < len(node)]
            here = here[(group[here] == group[here + k]) & (100 * n[here] >= percent * n[here + k])]
            take = here[(comp[here] != comp[here + k]) & ((lo[here] == hi[here]) | (part[here] != part[here + k]))]
            held.append((take, take + k))
            k += 1
            if sum(len(x) for x, _ in held) > 50_000 or not len(here):
                i, j = (np.concatenate(x) for x in zip(*held, strict=True))
                keep = drawn.near(i, j, n, percent)
                for x, y in zip(i[keep].tolist(), j[keep].tolist(), strict=True):
                    if joined.root(x) == joined.root(y):
                        continue
                    if exact and not _linked(sets[x].values.to_numpy(), sets[y].values.to_numpy(), percent):
                        continue
                    joined.join(x, y)
                    a.append(min(node[x], node[y]))
                    b.append(max(node[x], node[y]))
                held = []
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_cell(batches, 256 if exact else 2048):
            a, b = pairs(rows)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = cells.select(*names).repartition(F.col("entry"), F.col("lo"), F.col("hi")).sortWithinPartitions("entry", "lo", "hi", "n", "node")
    return dealt.mapInArrow(tidy(run), "a long, b long")


def _linked(h: np.ndarray, g: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(h, g, assume_unique=True))
    return 100 * both >= percent * (len(h) + len(g) - both)


def _classes(docs: DataFrame, words: int, percent: int, scratch: Scratch, cell: int = CELL, set_cell: int = SET_CELL) -> DataFrame:
    """Per row: doc, h, n, node, component (a node), component_doc, n_links; the last four null without shingles."""
    member = scratch.write(members(docs, words))
    reps = scratch.write(
        member.where("node IS NOT NULL")
        .groupBy("node")
        .agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("copies"), F.min("n").alias("n"), F.max("sketch").alias("sketch"))
    )
    star = scratch.write(_stars(_index(docs, words, percent, _frequent(docs, reps, words, scratch))))
    shared = star.groupBy(F.col("hub").alias("a"), F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    near = scratch.write(_near(shared, reps, percent))
    # First each node with the hub that it shares most entries with.
    best = near.groupBy("b").agg(F.max_by("a", F.struct("shared", F.negative(F.col("a").cast("decimal(20,0)")))).alias("a"))
    first = _verified(docs, reps, scratch.write(best.select("a", "b")), words, percent, scratch)
    links = first.where("linked").select("a", "b")
    comps = components(links, scratch)

    def of(df: DataFrame, name: str, to: str) -> DataFrame:
        """``df`` with the component of its column ``name`` as ``to``."""
        named = comps.select(F.col("node").alias(name), F.col("component").alias("__c"))
        return df.join(named, name, "left").withColumn(to, F.coalesce("__c", name)).drop("__c")

    # Then all hubs and nodes that are still in different components.
    crossing = of(of(near.select("a", "b"), "a", "ca"), "b", "cb").where("ca <> cb").select("a", "b")
    crossing = scratch.write(crossing.join(first.select("a", "b"), ["a", "b"], "left_anti"))
    if crossing.count():
        second = _verified(docs, reps, crossing, words, percent, scratch)
        links = links.unionByName(second.where("linked").select("a", "b"))
        comps = components(links, scratch)
    # Last, within the entries whose nodes are in several components, the pairs across these.
    full = star.select("entry", "node").unionByName(star.select("entry", F.col("hub").alias("node")).distinct())
    full = of(full, "node", "component")
    split = full.groupBy("entry").agg(
        F.min("component").alias("lo"),
        F.max("component").alias("hi"),
        F.count(F.lit(1)).alias("size"),
        *(F.sum(F.xxhash64(F.lit(i), "node").cast("decimal(38,0)")).alias(f"f{i}") for i in (1, 2)),
    )
    # Of entries with the same nodes one is enough.
    split = split.where("lo <> hi AND size > 2").groupBy("size", "f1", "f2").agg(F.min("entry").alias("entry"))
    split = scratch.write(split.select("entry", "size"))
    if split.count():
        drawn = reps.select("node", "n", "sketch")
        rest = full.join(split, "entry").join(drawn, "node")
        trees = components(_forest(_cells(rest, cell), percent, False), scratch).withColumnRenamed("component", "entry")
        trees = scratch.write(trees.union(trees.select("entry", "entry").distinct()))
        if trees.count():
            sizes = trees.join(reps.select("node", "n"), "node").groupBy("entry").agg((F.sum("n") * 8).alias("size"))
            sets = scratch.write(_sets(docs, reps, trees.select("node"), words, scratch).dropDuplicates(["node"]))
            rest = of(trees.join(sizes, "entry").join(drawn, "node"), "node", "component").join(sets, "node")
            third = scratch.write(_forest(_cells(rest, set_cell), percent, True))
            scratch.drop(sets)
            links = links.unionByName(third.distinct())
            comps = components(links, scratch)
    by_node = of(reps.select("node", "doc", "copies"), "node", "component")
    least = by_node.groupBy("component").agg(F.min("doc").alias("component_doc"))
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("ends"))
    named = scratch.write(
        by_node.join(least, "component")
        .join(ends, "node", "left")
        .select("node", "component", "component_doc", (F.col("copies") - 1 + F.coalesce("ends", F.lit(0))).alias("n_links"))
    )
    return member.drop("sketch").join(named, "node", "left")


def jaccard_components(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, n_links.

    A document's set holds the distinct shingles of ``words`` white-space words
    after A-Z are lower-cased; a shorter text is one shingle. Two documents link
    when 100 * intersection >= ``percent`` * union; component_id is the least
    doc_id reachable by links. A null or blank text has no shingles, links with
    nothing and is its own component. A null doc_id counts below all others.
    Equal sets always link; rows that repeat a doc_id each get a row. ``n_links``
    counts the links verified for the document's set plus its other copies: a
    spanning part of all links, enough to join each component.
    Hashes are 64 bits wide; two sets are taken as equal when theirs are.
    """
    rows = _classes(docs, words, percent, Scratch(docs.sparkSession))
    real = lambda c: F.when(F.col(c) != -(2**63), F.col(c))
    return rows.select(
        real("doc").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), real("doc")).otherwise(real("component_doc")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, most_sent: int = 1_000_000) -> DataFrame:
    """``docs`` less all but one document of each component: the one of least doc_id. Columns stay.

    Rows without shingles stay. Of rows with one doc_id and text one stays. At
    most ``most_sent`` ids are broadcast; more are taken out by a shuffled join.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = scratch.write(_classes(docs, words, percent, scratch).where("node IS NOT NULL").select("doc", "h", "component"))
    kept = rows.groupBy("component").agg(F.min(F.struct("doc", "h")).alias("kept"))
    gone = rows.join(kept, "component").where("kept <> struct(doc, h)").select("doc", "h").distinct()
    again = rows.groupBy("doc", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc", "h")
    gone, again = scratch.write(gone), scratch.write(again)
    scratch.drop_but(gone, again)
    small = lambda df: F.broadcast(df) if df.count() <= most_sent else df
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), doc_key().alias("doc"), F.xxhash64("text").alias("h"))
    left = keyed.join(small(gone), ["doc", "h"], "left_anti")
    if again.limit(1).count():
        once = left.join(small(again), ["doc", "h"], "left_semi").dropDuplicates(["doc", "h"])
        left = left.join(small(again), ["doc", "h"], "left_anti").unionByName(once)
    return left.select("row.*")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of ``documents``: its set's size and its component by links of 85 percent."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_components(docs).select("doc_id", "n_shingles", "component_id")


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(w) - least(4, len(w)) + 2),
                                      lambda i: array_to_string(w[i:i + least(4, len(w)) - 1], ' ')))) AS g
  FROM w WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), reach AS (
  SELECT doc_id, doc_id AS other FROM w UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON reach.other = link.a
), c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN c ON c.doc_id = w.doc_id
"""
