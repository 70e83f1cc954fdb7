"""Substring dedup by collinear chaining.

Words are hashed; of all runs of four words those of the lowest three tenths of
hashes are seeds, and where ten in a row have none the lowest of these, so that
texts which share a passage share the choice. Seeds that one
text alone holds are left out. The occurrences of the others are sorted by the
words that follow, and again by those that come before, and linked to the next
ones of other texts there: whoever shares most of an occurrence's surroundings
stands beside it, however many other texts hold the seed. So there are a few links
an occurrence; those whose surroundings look unlike are left out. The links of two
texts are chained:
ordered matches, less what their gaps cost, by a Fenwick tree that holds the best
chain up to each place. A match alone, or two or three that hold few words,
are a chain if the words beside one of them look like a part. Chains are then aligned word by word, over their gaps and
beyond their ends, and every stretch of the alignment that is alike enough counts,
whatever the rest of it is. What these cover of a text is joined; stretches
that are long enough are its repeated passages.

Equal texts are one text here; copies get the spans of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, doc_key, slices, table, thin_batches, tidy

K, GAP_COST, DROP = 4, 0.1, 12
#: Of all runs so many tenths are seeds, and the least of so many in a row that have none.
TENTHS, WINDOW = 3, 10
_MULTIPLIER = np.uint64(0x94D049BB133111EB)
#: Words on each side of a seed by which its occurrences are sorted, two bits each.
BESIDE = 16
#: Of the ten words on each side so many must look equal in a link.
ALIKE = 9
#: An alignment is looked for so many words beyond the ends of a chain.
MARGIN = 64


def _word_hashes(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """XXH3 (64 bits, seed 0) of the words of ``size`` bytes at ``at``, none empty; ``data`` goes on for 8 bytes beyond the last.

    The three forms of up to 16 bytes, which nearly all words are of, go over arrays.
    """
    out = np.empty(len(at), np.uint64)
    low, half = np.uint64(2**32 - 1), np.uint64(32)
    four = lambda i: np.ndarray(len(data) - 3, "<u4", data, strides=(1,))[i].astype(np.uint64)
    eight = lambda i: np.ndarray(len(data) - 7, "<u8", data, strides=(1,))[i]

    i = np.flatnonzero(size <= 3)
    p, n = at[i], size[i]
    first, mid, last = (data[q].astype(np.uint64) for q in (p, p + (n >> 1), p + n - 1))
    h = (first << np.uint64(16) | mid << np.uint64(24) | last | n.astype(np.uint64) << np.uint64(8)) ^ np.uint64(0x87275A9B)
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0x165667B19E3779F9)
    out[i] = h ^ h >> half

    i = np.flatnonzero((size > 3) & (size <= 8))
    p, n = at[i], size[i]
    h = (four(p + n - 4) + (four(p) << half)) ^ np.uint64(0xC73AB174C5ECD5A2)
    h ^= (h << np.uint64(49) | h >> np.uint64(15)) ^ (h << np.uint64(24) | h >> np.uint64(40))
    h *= np.uint64(0x9FB21C651E98DF25)
    h = (h ^ (h >> np.uint64(35)) + n.astype(np.uint64)) * np.uint64(0x9FB21C651E98DF25)
    out[i] = h ^ h >> np.uint64(28)

    i = np.flatnonzero((size > 8) & (size <= 16))
    p, n = at[i], size[i]
    x, y = eight(p) ^ np.uint64(0x6782737BEA4239B9), eight(p + n - 8) ^ np.uint64(0xAF56BC3B0996523A)
    xl, xh, yl, yh = x & low, x >> half, y & low, y >> half  # the upper half of the product of 128 bits
    mid = (xl * yl >> half) + xh * yl
    upper = (mid >> half) + ((mid & low) + xl * yh >> half) + xh * yh
    h = n.astype(np.uint64) + x.byteswap() + y + (x * y ^ upper)
    h = (h ^ h >> np.uint64(37)) * np.uint64(0x165667919E3779F9)
    out[i] = h ^ h >> half

    for i in np.flatnonzero(size > 16).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[at[i] : at[i] + size[i]])
    return out


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts: the bytes of all their words, A-Z lower-cased; each word's place in these and size; how many words each text has."""
    per_text = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words = per_text.flatten()
    kind = np.int64 if pa.types.is_large_string(words.type) else np.int32
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, kind)[words.offset :][: len(words) + 1].astype(np.int64) if len(words) else np.zeros(1, np.int64)
    size = np.diff(ends)
    some = size > 0  # white space at an end leaves an empty one
    number = np.diff(np.concatenate(([0], np.cumsum(some)))[np.cumsum(np.concatenate(([0], per_text.value_lengths().to_numpy())))])
    data = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(8, np.uint8)]) if len(words) and data else np.zeros(8, np.uint8)
    return data, ends[:-1][some], size[some], number


def seeds(h: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of so many words, with their hashes one after another: seed hashes, whose text each is, its place there, and what stands beside it.

    Seeds are three tenths of all runs, by their hashes, and the least of each window that has none of these.
    """
    # Texts stand apart by a gap, in which no run and no window begins.
    begin = np.cumsum(number) - number + BESIDE * np.arange(1, len(number) + 1)
    at = np.arange(len(h)) + np.repeat(BESIDE * np.arange(1, len(number) + 1), number)
    left = np.repeat(begin + number, number) - at
    apart = np.zeros(len(h) + BESIDE * (len(number) + 1), np.uint64)
    apart[at] = h
    n = len(apart) - K + 1
    run = np.zeros(n, np.uint64)
    for i in range(K):
        run = run * _MULTIPLIER + apart[i : n + i]
    run = (run ^ (run >> np.uint64(32))) * _MULTIPLIER
    run ^= run >> np.uint64(29)
    none = np.ones(n, bool)
    none[at[left >= K]] = False
    run[none] = np.uint64(2**64 - 1)
    chosen = run < np.uint64((TENTHS << 64) // 10)
    total = np.concatenate(([0], np.cumsum(chosen)))
    # A text of fewer runs than a window is one.
    start = np.concatenate([at[left >= K + WINDOW - 1], begin[(number >= K) & (number < K + WINDOW - 1)]])
    bare = start[total[start + WINDOW] == total[start]]
    chosen[bare + np.lib.stride_tricks.sliding_window_view(run, WINDOW)[bare].argmin(axis=1)] = True
    at = np.flatnonzero(chosen)
    text = np.searchsorted(begin, at, side="right") - 1
    return run[at], text, at - begin[text], beside(apart, at)


def beside(apart: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Two bits of each of the BESIDE words after (upper half) and before the seeds at ``at``, the nearest first; 0 beyond the text."""
    right = left = ((apart * _MULTIPLIER) >> np.uint64(62)).astype(np.uint32)
    size = 1
    while size < BESIDE:  # of twice as many words
        right = right[:-size] << np.uint32(2 * size) | right[size:]
        left = left[size:] << np.uint32(2 * size) | left[:-size]
        size *= 2
    return (right[at + K].astype(np.uint64) << np.uint64(32) | left[at - BESIDE]).view(np.int64)


def _best_ends(a: list[int], b: list[int]) -> tuple[list[float], list[int]]:
    """Of matches in order of a, then falling b: the score of the best chain up to each, and its forerunner in that, or -1."""
    n = len(a)
    places = sorted(set(b))
    rank = {x: i + 1 for i, x in enumerate(places)}
    size = len(places)
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (size + 1)
    score, back = [0.0] * n, [-1] * n
    i = 0
    for i in range(n):
        r = rank[b[i]] - 1
        best = (-1e18, -1)
        while r:
            if tree[r] > best:
                best = tree[r]
            r &= r - 1
        gain = best[0] - GAP_COST * (a[i] + b[i]) if best[1] >= 0 else -1.0
        score[i] = K
        if gain > 0 and a[best[1]] < a[i]:
            score[i] += gain
            back[i] = best[1]
        entry = (score[i] + GAP_COST * (a[i] + b[i]), i)
        r = rank[b[i]]
        while r <= size:
            if entry > tree[r]:
                tree[r] = entry
            r += r & -r
    return score, back


def chains(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Of matches (a[i], b[i]): index arrays of chains rising in both, best first; none shares a match.

    A chain's score is K a match less GAP_COST for each word of its gaps. Prefix
    maxima over b of score plus position, by a Fenwick tree, find each match's best
    forerunner; one that costs more than it brings is not taken.
    """
    order = np.lexsort((-b, a))
    a, b = a[order], b[order]
    n = len(a)
    cost = GAP_COST * (np.diff(a) + np.diff(b))
    if not len(cost) or cost.max() < K and (np.diff(a) > 0).all() and (np.diff(b) > 0).all():
        return [order]  # each adds to the one before
    score, back = _best_ends(a.tolist(), b.tolist())
    used, out = [False] * n, []
    for end in sorted(range(n), key=lambda j: (-score[j], j)):
        own = []
        while end >= 0 and not used[end]:
            used[end] = True
            own.append(end)
            end = back[end]
        if own:
            out.append(order[own[::-1]])
    return out


def _grown(x: np.ndarray, y: np.ndarray, drop: int = DROP) -> int:
    """How far two word arrays run alike from their start: to the last equal word before equals fall behind by more than ``drop``."""
    n = min(len(x), len(y))
    if not n:
        return 0
    equal = x[:n] == y[:n]
    score = np.cumsum(np.where(equal, 1, -3))
    low = np.flatnonzero(np.maximum.accumulate(np.maximum(score, 0)) - score > drop)
    at = np.flatnonzero(equal[: low[0]] if len(low) else equal)
    return int(at[-1]) + 1 if len(at) else 0


def align(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A chain of matches (a[i], b[i]) of K words in x and y, aligned over its gaps and beyond its ends.

    Its columns, as arrays: the place in x, the place in y, whether the words are
    equal. Where one side has no word, the place is that of its next one.
    """
    left = _grown(x[: a[0]][::-1], y[: b[0]][::-1])
    ax, by = int(a[0]) - left, int(b[0]) - left
    if len(a) == 1 or (a[-1] - a[0] == b[-1] - b[0] and (np.diff(a) == np.diff(b)).all()):  # side by side all along
        end = int(a[-1]) + K
        size = end - ax + _grown(x[end:], y[int(b[-1]) + K :])
        step = np.arange(size)
        return ax + step, by + step, x[ax : ax + size] == y[by : by + size]
    px, py = [], []

    def go(i: int, j: int) -> None:  # to (i, j): side by side, what one side has more after that
        nonlocal ax, by
        n = max(i - ax, j - by)
        step = np.arange(n)
        px.append(np.minimum(ax + step, i))
        py.append(np.minimum(by + step, j))
        ax, by = i, j

    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        if i < ax or j < by:
            start = max(ax - i, by - j)
            if start >= K:
                continue
            i, j, size = i + start, j + start, K - start
        else:
            size = K
        if i - ax != j - by and i > ax and j > by:
            ox, oy = ax, by
            for m in SequenceMatcher(None, x[ax:i].tolist(), y[by:j].tolist(), False).get_matching_blocks()[:-1]:
                go(ox + m.a, oy + m.b)
                go(ox + m.a + m.size, oy + m.b + m.size)
        go(i, j)
        go(i + size, j + size)
    right = _grown(x[ax:], y[by:])
    go(ax + right, by + right)
    px, py = np.concatenate(px), np.concatenate(py)
    both = (np.diff(px, append=ax) > 0) & (np.diff(py, append=by) > 0)
    equal = np.zeros(len(px), bool)
    equal[both] = x[px[both]] == y[py[both]]
    return px, py, equal


def parts(px: np.ndarray, py: np.ndarray, equal: np.ndarray, least: int, similarity: float) -> list[tuple[int, int, int, int]]:
    """Of an alignment: every longest stretch of ``least`` words on both sides, ``similarity`` of its columns equal; x and y ranges.

    A stretch begins and ends with equal words. The whole is one where so much of its
    longer side is equal; else parts are looked for. With 1 - similarity for an equal
    column and -similarity for another, it is one whose sum is not below 0: from each
    beginning the last end with a prefix sum not below its own is taken.
    """
    at = np.flatnonzero(equal)
    if not len(at):
        return []
    s, e, t, f = int(px[at[0]]), int(px[at[-1]]) + 1, int(py[at[0]]), int(py[at[-1]]) + 1
    if len(at) >= similarity * max(e - s, f - t):
        return [(s, e, t, f)] if min(e - s, f - t) >= least else []
    done = np.arange(1, len(at) + 1)
    low = done - 1 - similarity * at  # prefix sums before and after each equal column
    high = done - similarity * (at + 1)
    last = np.maximum.accumulate(high[::-1])[::-1]  # falls
    end = np.searchsorted(-last, -(low - 1e-9), side="right") - 1
    out, reach = [], -1
    for i, j in enumerate(end.tolist()):
        if j <= max(reach, i):
            continue
        reach = j
        s, e, t, f = int(px[at[i]]), int(px[at[j]]) + 1, int(py[at[i]]), int(py[at[j]]) + 1
        if min(e - s, f - t) >= least:
            out.append((s, e, t, f))
    return out


_SEEDED = ["seed", "text", "at", "beside"]


def _seeded(docs: DataFrame) -> DataFrame:
    """(seed, text, at, beside), each text once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()
        for batch in batches:
            for part in slices(batch, 512, 1 << 20):
                keys, new = part.column(0).to_numpy(), []
                for i, text in enumerate(keys.tolist()):
                    if text in done:
                        continue
                    if len(done) > 200_000:
                        done.clear()
                    done.add(text)
                    new.append(i)
                if new:
                    new = np.array(new)
                    data, at, size, number = _split(part.column(1).take(pa.array(new)))
                    seed, text, place, around = seeds(_word_hashes(data, at, size), number)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (seed.view(np.int64), keys[new[text]], place, around)], _SEEDED)

    return docs.select("text_key", "text").mapInArrow(tidy(run), ", ".join(f"{c} long" for c in _SEEDED))


def _counted(docs: DataFrame) -> DataFrame:
    """(doc, text_key, n): how many words a text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 512, 1 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(_split(part.column(2))[3])], ["doc", "text_key", "n"])

    return docs.select("doc", "text_key", "text").mapInArrow(tidy(run), "doc long, text_key long, n long")


def _dense(rows: np.ndarray, origin: int, step: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Which rows, but the first and the last, stand within a few words of others of the same seed, text and surroundings; and where each row's like ones begin, those of the first at ``origin``.

    These come from periodic text: what is aligned from a row near by covers them too.
    """
    like = (rows[:, 1:] == rows[:, :-1])[[0, 1, 3]].all(axis=0)
    first = np.maximum.accumulate(np.where(np.concatenate(([True], ~like)), np.arange(rows.shape[1]), 0))
    begin = np.where(first > 0, rows[2, first], origin)
    part = (rows[2] - begin) // step
    return like[:-1] & like[1:] & (part[1:-1] == part[:-2]) & (rows[2, 2:] - rows[2, 1:-1] <= step), begin


def _shared(seeded: DataFrame) -> DataFrame:
    """The seeds that several texts hold, less repeated and dense rows. Streams through sorted rows, of which it keeps two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_, begin = np.empty((len(_SEEDED), 0), np.int64), False, None  # the last rows, whether their seed is known to be shared, and where their like ones begin
        for last, batch in _with_last(batches):
            rows = held
            if batch is not None:
                rows = np.concatenate([held, np.stack([batch.column(i).to_numpy() for i in range(len(_SEEDED))])], axis=1)
            if not rows.shape[1]:
                continue
            rows = rows[:, np.concatenate(([True], (rows[:, 1:] != rows[:, :-1]).any(axis=0)))]
            seed, text = rows[:2]
            here = np.arange(len(seed))
            new = np.concatenate(([True], seed[1:] != seed[:-1]))
            first = np.maximum.accumulate(np.where(new, here, 0))
            other = text != text[first]
            # A seed is shared if any of its rows is of another text than its first.
            group = np.cumsum(new) - 1
            shared = np.bincount(group, weights=other, minlength=group[-1] + 1) > 0
            shared[0] |= open_
            keep = shared[group]
            dense, begin = _dense(rows, rows[2, 0] if begin is None else begin[-held.shape[1]])
            keep[1:-1] &= ~dense
            keep[0] &= not open_  # sent before, or dense
            open_ = bool(shared[-1])
            if not last:
                # The last row waits for the next, with the one before it; all rows of a seed that isn't known to be shared yet wait, they are of one text.
                tail = len(seed) - 1 if open_ else first[-1]
                keep[tail:] = False
                held = rows[:, tail - open_ :].copy()
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows[:, keep]], _SEEDED)

    dealt = seeded.repartition(F.col("seed")).sortWithinPartitions("seed", "text", "at")
    return dealt.mapInArrow(tidy(run), seeded.schema)


def _neighbours(batches: Iterator[pa.RecordBatch], part: tuple[int, float]) -> Iterator[pa.RecordBatch]:
    """Links of rows sorted by seed and by what stands beside, which stream through.

    A row is linked to the first text of those that have the same all around, or, where it
    is of that text itself, to the row before it of another text; rows of one text that stand
    together are linked to the next one of another text too.
    """
    held = None  # the first text's rows of the same surroundings, the row before the last run of one text, and that run
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(i).to_numpy() for i in range(len(_SEEDED))])
        old = 0 if held is None else held.shape[1]
        rows = rows if held is None else np.concatenate([held, rows], axis=1)
        seed, text, _, around = rows
        n, here = len(seed), np.arange(len(seed))
        new = np.concatenate(([True], (seed[1:] != seed[:-1]) | (text[1:] != text[:-1])))
        first = np.maximum.accumulate(np.where(new, here, 0))
        after = np.minimum.accumulate(np.where(np.append(new[1:], False), here + 1, n)[::-1])[::-1]
        like = np.concatenate(([True], (seed[1:] != seed[:-1]) | (around[1:] != around[:-1])))
        hub = np.maximum.accumulate(np.where(like, here, 0))
        # Rows of one text that are alike all around go to those of the hub's text in turn.
        start = np.maximum(first, hub)
        length = np.diff(np.append(np.flatnonzero(new | like), n))
        length = length[np.cumsum(new | like) - 1][hub]
        up = here[(here >= old) & (first > 0)]
        up = up[seed[up] == seed[first[up] - 1]]
        to = np.where(text[hub[up]] != text[up], hub[up] + (up - start[up]) % length[up], first[up] - 1)
        down = here[(after < n) & (after >= old)]
        down = down[(seed[down] == seed[after[down]]) & (after[down] - first[down] > 1)]
        yield _links(rows, np.concatenate([up, down]), np.concatenate([to, after[down]]), part)
        begin = max(0, first[-1] - 1)
        held = rows[:, begin:]
        if hub[-1] < begin:
            held = np.concatenate([rows[:, hub[-1] : min(begin, hub[-1] + length[-1])], held], axis=1)
        held = held.copy()


def _linked(shared: DataFrame, part: tuple[int, float]) -> DataFrame:
    """(x, y, a, b, near): a few links an occurrence, in both orders; may repeat rows."""
    dealt = shared.repartition(F.col("seed"))
    turned = F.shiftleft("beside", 32).bitwiseOR(F.shiftrightunsigned("beside", 32))
    one = dealt.sortWithinPartitions("seed", "beside", "text", "at").mapInArrow(lambda rows: _neighbours(rows, part), _LINK)
    two = dealt.sortWithinPartitions("seed", turned, "text", "at").mapInArrow(lambda rows: _neighbours(rows, part), _LINK)
    return one.union(two)


_LINK = "x long, y long, a long, b long, near long"


def likeness(one: np.ndarray, two: np.ndarray, least: int, similarity: float = 0.8) -> tuple[np.ndarray, ...]:
    """Of matches, by the words beside them: whether they may be a part of their own, and how far an alignment may reach after and before them.

    They may be if a stretch of ``least`` words around the match has ``similarity``
    equal, or up to two less. Words of the same two bits count as equal. A part has
    several matches, so one in a worse place of it is not needed. A reach is where the
    equal words fall behind by more than DROP, or MARGIN: see ``_grown``, which can't go
    further, as words that are equal have equal bits. Matches whose nearest words are
    unlike on both sides have no reach.
    """
    other = (one ^ two).view(np.uint64)
    n = min(max(least - K, 0), BESIDE)
    ends = np.zeros((2, BESIDE + 1, len(other)), np.int8)  # unequal words up to so far, after and before
    reach = np.full((2, len(other)), MARGIN, np.int64)
    for k, shift in enumerate((62, 30)):
        score, top = np.zeros(len(other), np.int8), np.zeros(len(other), np.int8)
        for i in range(BESIDE):
            unequal = (other >> np.uint64(shift - 2 * i)) & np.uint64(3) != 0
            ends[k, i + 1] = ends[k, i] + unequal
            score += np.where(unequal, np.int8(-3), np.int8(1))
            np.maximum(top, score, out=top)
            reach[k, (reach[k] == MARGIN) & (top - score > DROP)] = i
    alone = np.zeros(len(other), bool)
    for i in range(n + 1):
        alone |= ends[0, i] + ends[1, n - i] <= (1 - similarity) * (n + K) + 2 + 1e-9
    alike = ends[0, 10] + ends[1, 10] <= 20 - ALIKE
    reach[:, ~(alike | alone)] = -1
    return alone, reach[0], reach[1]


def _links(rows: np.ndarray, i: np.ndarray, j: np.ndarray, part: tuple[int, float]) -> pa.RecordBatch:
    """Links of rows i and j (seed, text, at, beside) that look alike, the lesser text second; ``near``: 2 bytes of reach, and whether alone."""
    alone, right, left = likeness(rows[3, i], rows[3, j], *part)
    keep = right >= 0
    near = ((left << 8 | right) << 1 | alone)[keep]
    i, j = i[keep], j[keep]
    turn = rows[1, i] < rows[1, j]
    i, j = np.where(turn, j, i), np.where(turn, i, j)
    columns = (rows[1, i], rows[1, j], rows[2, i], rows[2, j], near)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["x", "y", "a", "b", "near"])


def _straight(a: np.ndarray, b: np.ndarray, chain: np.ndarray, most: int = 24) -> list[np.ndarray]:
    """The parts of a chain between gaps that are much longer on one side; none if it has no such gap."""
    jumps = np.flatnonzero(np.abs(np.diff(a[chain]) - np.diff(b[chain])) > most) + 1
    return np.split(chain, jumps) if len(jumps) else []


_CHAIN = "x long, y long, a array<long>, b array<long>, xlo long, xhi long, ylo long, yhi long, few boolean"


def _chained(links: DataFrame, least: int, block: int = 16) -> DataFrame:
    """Links may repeat. One row a chain that may reach ``least`` words, that holds 3 * K words in its matches, or a match that may grow, with the ranges of x and y that its alignment may need.

    ``few``: a chain that holds fewer words than that, or a part of another one beside a long gap.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for last, batch in _with_last(batches):
            part = pa.Table.from_batches([*([held] if held is not None else []), *([batch] if batch is not None else [])]) if held is not None or batch is not None else None
            if part is None or not part.num_rows:
                continue
            part = part.combine_chunks()
            x, y, a, b = (part[c].to_numpy() for c in "xyab")
            again = np.concatenate(([False], (x[1:] == x[:-1]) & (y[1:] == y[:-1]) & (a[1:] == a[:-1]) & (b[1:] == b[:-1])))
            if again.any():
                part = part.filter(pa.array(~again)).combine_chunks()
                x, y, a, b = (part[c].to_numpy() for c in "xyab")
            near = part["near"].to_numpy()
            alone, right, left = (near & 1).astype(bool), near >> 1 & 255, near >> 9
            cuts = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]), [True])))
            if not last:
                held = part.slice(cuts[-2]).to_batches()[0]
                cuts = cuts[:-1]
            size = np.diff(cuts)
            # Pairs of one match, all at once.
            one = cuts[:-1][size == 1]
            one = one[alone[one] & (left[one] + K + right[one] >= least)]
            ends = [end for c in (a, b) for end in (np.maximum(0, c[one] - left[one]) // block * block, -(-(c[one] + K + right[one]) // block) * block)]
            own, found_in, few = [at.reshape(1) for at in one], one.tolist(), [True] * len(one)
            ends = [c.tolist() for c in ends]
            for i, j in zip(cuts[:-1][size > 1].tolist(), cuts[1:][size > 1].tolist(), strict=True):
                found: set[int] = set()
                p, q, may = a[i:j], b[i:j], alone[i:j]
                whole = chains(p, q)
                for at in [*whole, *(part for chain in whole if len(chain) > 1 for part in _straight(p, q, chain))]:
                    first, last_ = int(at[0]), int(at[-1])
                    little = first in found or len(at) < 3 or bool(K + np.minimum(np.diff(p[at]), K).sum() < 3 * K)
                    if little and not may[at].any():
                        continue
                    found.update(at.tolist())
                    before, after = int(left[i + first]), K + int(right[i + last_])
                    lo, hi, ylo, yhi = int(p[first]), int(p[last_]), int(q[first]), int(q[last_])
                    if max(hi - lo, yhi - ylo) + before + after < least:
                        continue
                    own.append(at + i)
                    found_in.append(i)
                    few.append(little)
                    for c, v in zip(ends, (max(0, lo - before) // block, -(-(hi + after) // block), max(0, ylo - before) // block, -(-(yhi + after) // block)), strict=True):
                        c.append(v * block)
            if own:
                flat, n = np.concatenate(own), np.concatenate(([0], np.cumsum([len(at) for at in own]))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(n), pa.array(c[flat])) for c in (a, b)]
                made = [pa.array(x[found_in]), pa.array(y[found_in]), *lists, *(pa.array(c, pa.int64()) for c in ends), pa.array(few, pa.bool_())]
                yield pa.RecordBatch.from_arrays(made, ["x", "y", "a", "b", "xlo", "xhi", "ylo", "yhi", "few"])

    dealt = links.repartition(F.col("x"), F.col("y")).sortWithinPartitions("x", "y", "a", "b")
    return dealt.mapInArrow(tidy(run), _CHAIN)


def _with_last(batches: Iterator) -> Iterator[tuple[bool, pa.RecordBatch | None]]:
    for batch in batches:
        yield False, batch
    yield True, None


def _pieces(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(text, lo, hi, words) for the ranges that chains need: 32 bits of the word hashes, fewer words where the text ends."""
    per_text = wanted.groupBy("text").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    joined = texts.join(per_text, texts.text_key == per_text.text).select(per_text.text, texts.body, "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 256, 1 << 20):
                data, at, size, number = _split(part.column(1))
                h = _word_hashes(data, at, size).astype(np.uint32).view(np.int32)
                ranges = part.column(2)
                owner = np.repeat(np.arange(len(number)), ranges.value_lengths().to_numpy())
                lo, hi = (pc.struct_field(ranges.flatten(), c).to_numpy() for c in ("lo", "hi"))
                start, end = (np.minimum(c, number[owner]) + (np.cumsum(number) - number)[owner] for c in (lo, hi))
                upto = np.concatenate(([0], np.cumsum(end - start)))
                i = 0
                while i < len(owner):  # so many that their words take about 8 MB
                    j = max(i + 1, int(np.searchsorted(upto, upto[i] + (1 << 21), side="right")) - 1)
                    here = np.arange(upto[i], upto[j]) + np.repeat(start[i:j] - upto[i:j], end[i:j] - start[i:j])
                    words = pa.ListArray.from_arrays(pa.array((upto[i : j + 1] - upto[i]).astype(np.int32)), pa.array(h[here]))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner[i:j])), pa.array(lo[i:j]), pa.array(hi[i:j]), words], ["text", "lo", "hi", "words"])
                    i = j

    return joined.mapInArrow(tidy(run), "text long, lo long, hi long, words array<int>")


def _aligned(rows: DataFrame, least: int, similarity: float) -> DataFrame:
    """(text, start, end, partner) of both sides of each part of a chain that aligns well enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            flat = {n: cols[n].to_pylist() for n in ("x", "y", "xlo", "ylo")}
            lists = [(cols[n].flatten().to_numpy(), np.concatenate(([0], np.cumsum(cols[n].value_lengths().to_numpy()))).tolist()) for n in ("a", "b", "xw", "yw")]
            for i in range(batch.num_rows):
                a, b, p, q = (values[at[i] : at[i + 1]] for values, at in lists)
                xlo, ylo = flat["xlo"][i], flat["ylo"][i]
                x, y = flat["x"][i], flat["y"][i]
                for s, e, t, f in parts(*align(p, q, a - xlo, b - ylo), least, similarity):
                    out += [(x, s + xlo, e + xlo, y), (y, t + ylo, f + ylo, x)]
            made = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in made], ["text", "start", "end", "partner"])

    return rows.mapInArrow(tidy(run), "text long, start long, end long, partner long")


def _joined_up(spans: DataFrame, least: int) -> DataFrame:
    """(text, start, end, partner): spans of a text that touch, as one; only long ones. Streams through sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for last, batch in _with_last(batches):
            out = []
            rows = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True) if batch is not None else ()
            for text, start, end, partner in rows:
                if now and now[0] == text and start <= now[2]:
                    if end - start > now[4]:
                        now[3], now[4] = partner, end - start
                    now[2] = max(now[2], end)
                    continue
                if now and now[2] - now[1] >= least:
                    out.append(now[:4])
                now = [text, start, end, partner, end - start]
            if last and now and now[2] - now[1] >= least:
                out.append(now[:4])
            made = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in made], ["text", "start", "end", "partner"])

    dealt = spans.groupBy("text", "start", "end").agg(F.min("partner").alias("partner"))
    dealt = dealt.repartition(F.col("text")).sortWithinPartitions("text", "start", "end", "partner")
    return dealt.mapInArrow(tidy(run), "text long, start long, end long, partner long")


def _uncovered(chains: DataFrame, spans: DataFrame) -> DataFrame:
    """The ``chains`` of which a match stands outside ``spans`` (text, start, end, disjoint) in x or y. Streams through sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, end = None, -1
        for batch in batches:
            keep = []
            for text, at, upto, point in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if text != now:
                    now, end = text, -1
                keep.append(point and at + K > end)
                if not point:
                    end = upto
            chain = batch.column(4).filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays(chain.flatten(), names)

    chain = F.struct(*chains.columns).alias("chain")
    names, none = chains.columns, F.lit(None).cast(chains.select(chain).schema["chain"].dataType)
    at = lambda side, places: chains.select(F.col(side).alias("text"), F.explode(places).alias("at"), F.lit(0).cast("long").alias("upto"), F.lit(True).alias("point"), chain)
    rows = spans.select("text", "start", "end", F.lit(False), none).union(at("x", "a")).union(at("y", "b")).toDF("text", "at", "upto", "point", "chain")
    dealt = rows.repartition(F.col("text")).sortWithinPartitions("text", "at", "point")
    return dealt.mapInArrow(tidy(run), chains.schema).dropDuplicates(["x", "y", "a", "b"])


def repeated_passages(docs: DataFrame, min_words: int = 50, min_part: int = 20, similarity: float = 0.8) -> DataFrame:
    """One row per repeated passage: doc_id, start, end (words, end exclusive), partner_id.

    ``docs``: doc_id, text. Words are what white space parts, A-Z lower-cased. A
    passage is a stretch of ``min_words`` words or more that parts of at least
    ``min_part`` words cover, each aligned with a part of another document with
    ``similarity`` of its words equal. ``partner_id`` is the least doc_id of the
    text that the longest of those parts stands in. Both sides of a repeat have
    rows; a document that shares nothing has none. Copies of a whole text of
    ``min_words`` words or more have one more row over all of it. A passage that
    comes twice in a document and also in another counts at both places. Null, empty
    and short texts have no rows; rows that repeat a doc_id and text count once; null ids count
    below all others.
    """
    scratch = Scratch(docs.sparkSession)
    with thin_batches(docs.sparkSession):
        return _passages(scratch, docs, min_words, min_part, similarity)


def _passages(scratch: Scratch, docs: DataFrame, min_words: int, min_part: int, similarity: float) -> DataFrame:
    keyed = docs.where("text IS NOT NULL").select(doc_key().alias("doc"), F.xxhash64("text").alias("text_key"), "text")
    owners = scratch.write(_counted(keyed).distinct())
    firsts = scratch.write(owners.groupBy("text_key").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("copies")))
    shared = scratch.write(_shared(_seeded(keyed)))
    chained = scratch.write(_chained(_linked(shared, (min_part, similarity)), min_part))
    scratch.drop(shared)

    def aligned(chains: DataFrame) -> DataFrame:
        wanted = chains.select(F.col("x").alias("text"), F.col("xlo").alias("lo"), F.col("xhi").alias("hi"))
        wanted = scratch.write(wanted.union(chains.select("y", "ylo", "yhi")).distinct())
        needed = scratch.write(firsts.join(wanted.select(F.col("text").alias("text_key")), "text_key", "left_semi").select(F.col("first").alias("doc"), "text_key"))
        texts = keyed.join(F.broadcast(needed) if needed.count() <= 500_000 else needed, ["doc", "text_key"], "left_semi")
        pieces = scratch.write(_pieces(texts.select("text_key", F.col("text").alias("body")), wanted).dropDuplicates(["text", "lo", "hi"]))
        side = lambda s: pieces.select(
            F.col("text").alias(s), F.col("lo").alias(f"{s}lo"), F.col("hi").alias(f"{s}hi"), F.col("words").alias(f"{s}w")
        )
        rows = chains.join(side("x"), ["x", "xlo", "xhi"]).join(side("y"), ["y", "ylo", "yhi"])
        spans = _aligned(rows.select("x", "y", "a", "b", "xlo", "ylo", "xw", "yw"), min_part, similarity)
        spans = scratch.write(spans.groupBy("text", "start", "end").agg(F.min("partner").alias("partner")))
        scratch.drop(wanted, needed, pieces)
        return spans

    # First the chains that hold much; then those others that say something of words which these don't cover.
    spans = aligned(chained.where("NOT few"))
    rest = scratch.write(_uncovered(chained.where("few"), _joined_up(spans, 1)))
    spans = spans.union(aligned(rest))
    long = scratch.write(_joined_up(spans, min_words))
    partner = firsts.select(F.col("text_key").alias("partner"), F.col("first").alias("partner_id"))
    found = long.join(partner, "partner").join(owners.select("doc", F.col("text_key").alias("text")), "text")
    found = found.select("doc", "start", "end", "partner_id")
    copies = owners.join(firsts.where("copies > 1"), "text_key").where(F.col("n") >= min_words)
    copies = copies.select("doc", F.lit(0).cast("long").alias("start"), F.col("n").alias("end"), F.col("first").alias("partner_id"))
    real = lambda c: F.when(F.col(c) != -(2**63), F.col(c))
    return found.unionByName(copies).select(real("doc").alias("doc_id"), "start", "end", real("partner_id").alias("partner_id"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of ``documents`` of 50 words or more that other documents repeat, also fuzzily."""
    return repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
