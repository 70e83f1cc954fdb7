"""Query expansion by a thesaurus, as an expression: the table is small and fixed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.fixed import THESAURUS


def expand(query: Column, max_terms: int = 12, thesaurus: dict[str, list[str]] = THESAURUS) -> Column:
    """(query, terms, matched): terms of the keys that the query holds, longest keys first, each term once.

    A term that the query (lower-cased) holds is left out. ``matched`` has the keys
    looked at before the terms were ``max_terms``.
    """
    keys = sorted(thesaurus, key=len, reverse=True)
    struct = lambda k: F.struct(F.lit(k).alias("key"), F.array(*map(F.lit, thesaurus[k])).alias("terms"))
    query = F.coalesce(query, F.lit(""))
    low = F.lower(query)
    held = F.filter(F.array(*map(struct, keys)), lambda e: F.contains(query, e["key"]))

    def take(state: Column, entry: Column) -> Column:
        full = F.size(state["terms"]) >= max_terms
        new = F.filter(entry["terms"], lambda t: ~F.contains(low, F.lower(t)))
        terms = F.slice(F.array_distinct(F.concat(state["terms"], new)), 1, max_terms)
        return F.struct(
            F.when(full, state["terms"]).otherwise(terms).alias("terms"),
            F.when(full, state["matched"]).otherwise(F.concat(state["matched"], F.array(entry["key"]))).alias("matched"),
        )

    none = F.array().cast("array<string>")
    found = F.aggregate(held, F.struct(none.alias("terms"), none.alias("matched")), take)
    widened = F.when(F.size(found["terms"]) > 0, F.concat_ws(" ", query, F.concat_ws(" ", found["terms"]))).otherwise(query)
    return F.struct(widened.alias("query"), found["terms"].alias("terms"), found["matched"].alias("matched"))
