"""Query expansion by a thesaurus that is a table, of keys by the hundred thousand.

All keys that a text holds are found in one pass over it, by an automaton of all keys
(Aho and Corasick's), and the text's terms are taken in the same row. The table is sent
out up to a size; beyond it texts are cut into substrings of each length that keys have,
which meet the keys in a join, and come back to their text as one row.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Automaton:
    """Finds all of ``keys`` in a text: goto edges, failure links, and for each state the nearest key that ends there."""

    def __init__(self, keys: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.key, self.fail, self.up = [-1], [0], [0]
        for n, key in enumerate(keys):
            state = 0
            for c in key:
                step = self.next[state].get(c)
                if step is None:
                    step = self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.key.append(-1)
                state = step
            self.key[state] = n
        self.fail, self.up = [0] * len(self.next), [0] * len(self.next)
        todo = deque(self.next[0].values())
        while todo:
            state = todo.popleft()
            back = self.fail[state]
            self.up[state] = back if self.key[back] >= 0 else self.up[back]
            for c, child in self.next[state].items():
                while back and c not in self.next[back]:
                    back = self.fail[back]
                self.fail[child] = self.next[back].get(c, 0)
                back = self.fail[state]
                todo.append(child)

    def found(self, text: str) -> set[int]:
        out: set[int] = set()
        state = 0
        for c in text:
            while state and c not in self.next[state]:
                state = self.fail[state]
            state = self.next[state].get(c, 0)
            at = state
            while at:
                if self.key[at] >= 0:
                    if self.key[at] in out:
                        break  # so are the shorter ones that end here
                    out.add(self.key[at])
                at = self.up[at]
        return out


class Keys:
    """The ``keys`` in texts. Those without white space are looked for word by word, and what a word holds is remembered: words repeat."""

    def __init__(self, keys: list[str], most: int = 1 << 16, longest: int = 64):
        parts = [i for i, k in enumerate(keys) if k.split() == [k]], [i for i, k in enumerate(keys) if k.split() != [k]]
        self.within, self.across = ((own, Automaton([keys[i] for i in own])) for own in parts)
        self.least = min((len(keys[i]) for i in parts[0]), default=0)
        self.starts = {keys[i][: self.least] for i in parts[0]}  # a word that has none of them holds no key
        self.known: dict[str, tuple[int, ...]] = {}
        self.most, self.longest = most, longest

    def found(self, text: str) -> set[int]:
        own, automaton = self.within
        out: set[int] = set()
        n, starts = self.least, self.starts
        for word in set(text.split()) if own else ():
            if len(word) < n:
                continue
            held = self.known.get(word)
            if held is None:
                some = not starts.isdisjoint([word[i : i + n] for i in range(len(word) - n + 1)])
                held = tuple(own[i] for i in automaton.found(word)) if some else ()
                if len(word) <= self.longest:
                    if len(self.known) >= self.most:
                        self.known.clear()
                    self.known[word] = held
            if held:
                out.update(held)
        own, automaton = self.across
        if own:
            out.update(own[i] for i in automaton.found(text))
        return out


def _cut(n: int) -> Column:
    """The distinct substrings of ``n`` characters of a text of as many or more."""
    starts = F.sequence(F.lit(1), F.length("text") - n + 1)
    return F.array_distinct(F.transform(starts, lambda i: F.substr("text", i, F.lit(n))))


def held_keys(texts: DataFrame, keys: DataFrame, most_sent: int = 8 << 20) -> DataFrame:
    """(query_id, key): the ``keys`` (key) that each of ``texts`` (query_id, text) holds. Empty and null keys are held by none.

    Up to ``most_sent`` characters of keys go out as an automaton; more meet the texts in a join.
    """
    keys = keys.select("key").where("key <> ''").distinct()
    size = keys.agg(F.sum(F.length("key"))).first()[0] or 0
    texts = texts.select(F.col("query_id").cast("string").alias("query_id"), "text").where("text IS NOT NULL")
    if size > most_sent:
        lengths = [r.n for r in keys.select(F.length("key").alias("n")).distinct().collect()]  # as many as keys have lengths
        cuts = None
        for n in lengths:
            rows = texts.where(F.length("text") >= n).select("query_id", F.explode(_cut(n)).alias("key"))
            cuts = rows if cuts is None else cuts.unionByName(rows)
        return cuts.join(keys, "key", "left_semi").select("query_id", "key")
    names = sorted(r.key for r in keys.collect())
    sent = texts.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = None
        for batch in batches:
            finder = finder or Keys(sent.value)
            ids, found = [], []
            for query, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = sorted(finder.found(text))
                ids += [query] * len(own)
                found += [sent.value[i] for i in own]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.string())], ["query_id", "key"])

    return texts.mapInArrow(run, "query_id string, key string")


def _taken(low: str, entries: Iterable[tuple[str, list[str | None], list[str | None]]], most: int) -> tuple[list[str], list[str]]:
    """(terms, matched) of a lower-cased text, from the (key, terms, lower-cased terms) that it holds, in order."""
    terms: dict[str, None] = {}
    matched: list[str] = []
    for key, own, lowered in entries:
        if len(terms) >= most:
            break
        matched.append(key)
        for term, small in zip(own, lowered, strict=True):
            if term is not None and term not in terms and small not in low:
                terms[term] = None
    return list(terms)[:most], matched


def expand_by_table(
    queries: DataFrame, thesaurus: DataFrame, max_terms: int = 12, most_sent: int = 8 << 20, cut: Callable[[DataFrame], DataFrame] = lambda df: df
) -> DataFrame:
    """(query_id, query, terms, matched) of ``queries`` (query_id, text) by ``thesaurus`` (key, terms array), as ``expansion.expand`` has them.

    Longest keys come first, of equal lengths the first by code point; of rows that
    repeat a key the least terms count. Each term stands once, and not where the text
    (lower-cased) holds it already; ``matched`` has the keys looked at before the terms
    were ``max_terms``. A text's row is all that its terms need: nothing is shuffled where
    keys and terms of up to ``most_sent`` characters are sent out. With more, a text's
    keys meet it as one row, so queries should have different ids.
    """
    none = F.array().cast("array<string>")
    known = thesaurus.where("key <> ''").groupBy("key").agg(F.coalesce(F.min("terms"), none).alias("terms")).withColumn("lowered", F.transform("terms", F.lower))
    plain = F.octet_length("text") == F.length("text")  # lower-cased where it is read, others as Spark has it
    texts = queries.select(F.col("query_id").cast("string").alias("query_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("low", F.when(~plain, F.lower("text")))
    size = known.agg(F.sum(F.length("key") + F.aggregate("terms", F.lit(0), lambda n, t: n + F.coalesce(F.length(t), F.lit(0))))).first()[0] or 0
    sent = None
    if size <= most_sent:
        table = sorted(((r.key, r.terms, r.lowered) for r in known.collect()), key=lambda e: (-len(e[0]), e[0]))
        sent = queries.sparkSession.sparkContext.broadcast(table)
    else:
        entry = F.struct((-F.length("key")).alias("n"), "key", "terms", "lowered")
        held = cut(held_keys(texts, known, 0).join(known, "key").groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("entries")))
        texts = texts.join(held, "query_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = None
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                kept, matched = [], []
                held = [None] * part.num_rows if sent else part.column(3).to_pylist()
                for text, low, own in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), held, strict=True):
                    if sent:
                        finder = finder or Keys([e[0] for e in sent.value])
                        entries = (sent.value[i] for i in sorted(finder.found(text)))
                    else:
                        entries = ((e["key"], e["terms"], e["lowered"]) for e in own or [])
                    terms, keys = _taken(text.lower() if low is None else low, entries, max_terms)
                    kept.append(terms)
                    matched.append(keys)
                lists = [pa.array(v, pa.list_(pa.string())) for v in (kept, matched)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists], ["query_id", "text", "terms", "matched"])

    out = texts.mapInArrow(run, "query_id string, text string, terms array<string>, matched array<string>")
    widened = F.when(F.size("terms") > 0, F.concat_ws(" ", "text", F.concat_ws(" ", "terms"))).otherwise(F.col("text"))
    return out.select("query_id", widened.alias("query"), "terms", "matched")
