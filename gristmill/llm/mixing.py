"""Mixing sources to target weights by Sainte-Laguë apportionment. Column functions only.

The corpus is cut into blocks of so many words. Sources get whole blocks by the
highest quotients target / (2k - 1) of their k-th block; each source's blocks go on
to its shards, by the same rule and the shards' own blocks as votes, which gives an
integer quota for each shard. In a shard the documents lie in a seeded order on a
ring; a quota is so many whole rounds and an arc of blocks that starts at a seeded
block. So no more than a document at each end of an arc is cut.

Seats that are sure to be won are counted at once (all quotients above a threshold
that fewer than all seats pass); only the last ones, three a party at most, are
ranked. Shards are apportioned down a tree of bounded fan-out, so that a source of a
third of all rows is no single group anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

WORD = r"[^\x20\x09-\x0D]+"
#: No document is used more often.
MOST = 3


def targets(sources: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = MOST) -> DataFrame:
    """``sources`` (source, size) with source_no, weight and ``target``; the targets' sum is that of the sizes.

    Sources by code point, null last, have the weights in turn. A target is its
    weight's share, or ``most`` times its size if that is less; the rest's share grows
    by what these leave, until none is above. That share is found in one pass over
    the sources in the order in which they reach their limit.
    """
    order = Window.partitionBy().orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("source_no") - 1) % len(weights) + 1)
    rows = sources.withColumn("source_no", F.row_number().over(order)).withColumn("weight", weight)
    full = Window.partitionBy()
    before = full.orderBy(F.col("limit") / F.col("weight"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    after = full.orderBy(F.col("limit") / F.col("weight"), "source_no").rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("limit", F.col("size") * F.lit(float(most)))
    left = F.sum("size").over(full) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    rows = rows.withColumn("share", left / F.sum("weight").over(after))
    open_ = F.when(F.col("share") <= F.col("limit") / F.col("weight"), F.col("share"))
    rows = rows.withColumn("share", F.min_by(open_, F.when(open_.isNotNull(), F.struct(F.col("limit") / F.col("weight"), "source_no"))).over(full))
    return rows.withColumn("target", F.least("limit", F.col("weight") * F.col("share"))).drop("limit", "share")


def apportion(parties: DataFrame, group: list[str], key: str, votes: str, seats: str, limit: str) -> DataFrame:
    """``parties`` with ``won``: the seats that each gets of its group's ``seats``, by Sainte-Laguë's highest quotients.

    Of equal quotients the smaller ``key`` comes first. No party gets more than its
    ``limit``; groups without votes win nothing.
    """
    own = Window.partitionBy(*group)
    n, total = F.count(F.lit(1)).over(own), F.sum(F.col(votes).cast("double")).over(own)

    def passing(of: Column) -> Column:  # how many of a party's quotients pass when about ``of`` seats are given
        found = F.floor(F.col(votes) * F.greatest(F.lit(0), of) / F.col("_total") + 0.5)
        return F.when(F.col("_total") > 0, F.least(found, F.col(limit))).otherwise(0).cast("long")

    rows = parties.withColumns({"_n": n, "_total": total})
    rows = rows.withColumns({"_sure": passing(F.col(seats) - F.col("_n")), "_last": passing(F.col(seats) + 2 * F.col("_n") + 1)})
    rows = rows.withColumn("_sure", F.when(F.col(seats) > F.col("_n"), F.col("_sure")).otherwise(F.lit(0).cast("long")))
    rows = rows.withColumn("_open", F.col(seats) - F.sum("_sure").over(own))
    more = F.when(F.col("_last") > F.col("_sure"), F.sequence(F.col("_sure") + 1, F.col("_last"))).otherwise(F.array().cast("array<bigint>"))
    tried = rows.select(*group, key, "_open", F.col(votes).alias("_votes"), F.explode(more).alias("_k"))
    best = Window.partitionBy(*group).orderBy(F.desc(F.col("_votes") / (2 * F.col("_k") - 1)), key)
    added = tried.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= F.col("_open"))
    ids = list(dict.fromkeys([*group, key]))
    added = added.groupBy(*ids).agg(F.count(F.lit(1)).alias("_added"))
    out = rows.join(added, ids, "left").withColumn("won", F.col("_sure") + F.coalesce("_added", F.lit(0)))
    return out.select(*parties.columns, "won")


def _number(text: Column, start: int) -> Column:
    """48 bits of an MD5, from its hexadecimal digit ``start``."""
    return F.conv(F.substring(F.md5(text), start, 12), 16, 10).cast("long")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (1, 2, 3),
    most: int = MOST,
    block: int = 16,
    shard_words: int = 65_536,
    shard_docs: int = 256,
    fan_out: int = 1_000,
    seed: int = 13,
) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text, source): doc_id, source, size, source_size, target, taken, rounds, arcs.

    ``size``: the text's words (null: none). The mix uses a document ``rounds`` times
    as a whole and besides its words in ``arcs``, an array of (start, end), end exclusive;
    ``taken`` words in all, ``most`` times the size at most. A source's taken words differ
    from its target by a few blocks for each of its shards, of which each has
    ``shard_words`` words and ``shard_docs`` documents, about.

    Rows that repeat an id, source and size are copies, each with its own place on the
    ring; which is which is not told. A null id is an id like another. A null source is
    the last one, an empty one the first. Documents without words get a target like the
    rest's and are taken never. Other columns are dropped. The table of sources has a row a
    source, and is sent out only up to 10,000 of them.
    """
    scratch = Scratch(docs.sparkSession)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"))
    rows = scratch.write(rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies")))
    sums = [F.sum(F.col("size") * F.col("copies")).alias("size"), F.sum("copies").alias("n_docs")]
    sources = targets(rows.groupBy("source").agg(*sums), weights, most)
    shards = F.greatest(F.lit(1), F.ceil(F.col("size") / shard_words), F.ceil(F.col("n_docs") / shard_docs)).cast("long")
    sources = scratch.write(sources.withColumn("n_shards", shards))
    named = sources.select(F.col("source").alias("_source"), "source_no", F.col("size").alias("source_size"), "target", "n_shards")
    named = F.broadcast(named) if sources.count() <= 10_000 else named

    # Every copy's shard and place.
    each = rows.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    each = each.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")
    label = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy").cast("string"))
    each = each.withColumns({"shard": F.pmod(_number(label, 1), F.col("n_shards")), "place": _number(label, 13)})
    each = scratch.write(each.drop("n_shards"))

    leaves = each.groupBy("source_no", F.col("shard").alias("unit")).agg(F.sum("size").alias("words"))
    leaves = scratch.write(leaves.withColumn("blocks", F.ceil(F.col("words") / block).cast("long")))
    own = leaves.groupBy("source_no").agg((F.sum("blocks") * most).alias("limit"))
    house = F.round(F.sum("size").over(Window.partitionBy()) / block).cast("long")
    parties = sources.select("source_no", "target", house.alias("seats"), F.lit(0).alias("everything")).join(own, "source_no")
    quotas = scratch.write(apportion(parties, ["everything"], "source_no", "target", "seats", "limit").select("source_no", "won"))
    quotas = _shared_out(scratch, leaves, quotas, most, fan_out)

    ring = Window.partitionBy("source_no", "shard").orderBy("place", "doc_id", "size", "copy")
    end = F.sum("size").over(ring.rowsBetween(Window.unboundedPreceding, 0))
    laid = each.withColumn("end", end).join(quotas.withColumnRenamed("unit", "shard"), ["source_no", "shard"])
    first = F.pmod(_number(F.concat_ws(":", F.lit(f"{seed}:arc"), F.col("source_no").cast("string"), F.col("shard").cast("string")), 1), F.greatest(F.col("blocks"), F.lit(1)))
    laid = laid.withColumns(
        {
            "start": F.col("end") - F.col("size"),
            "rounds": F.when(F.col("blocks") > 0, F.floor(F.col("won") / F.col("blocks"))).otherwise(0).cast("long"),
            "from": first * block,
            "length": F.col("blocks") * block,
        }
    )
    laid = laid.withColumn("to", F.col("from") + (F.col("won") - F.col("rounds") * F.col("blocks")) * block)

    def part(a: Column, b: Column) -> Column:  # of the ring, within the document
        return F.struct((F.greatest("start", a) - F.col("start")).alias("start"), (F.least("end", b) - F.col("start")).alias("end"))

    arcs = F.array(part(F.lit(0).cast("long"), F.col("to") - F.col("length")), part(F.col("from"), F.least("to", "length")))
    laid = laid.withColumn("arcs", F.filter(arcs, lambda x: x["end"] > x["start"]))
    taken = F.aggregate("arcs", F.col("rounds") * F.col("size"), lambda s, x: s + x["end"] - x["start"])
    return laid.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "rounds", "arcs")


def _shared_out(scratch: Scratch, leaves: DataFrame, quotas: DataFrame, most: int, fan_out: int) -> DataFrame:
    """``leaves`` (source_no, unit, blocks) with ``won`` of each source's quota, down a tree of bounded fan-out."""
    levels = [leaves.select("source_no", "unit", "blocks")]
    widest = levels[0].agg(F.max("unit")).first()[0] or 0
    while widest >= fan_out:
        parent = F.floor(F.col("unit") / fan_out).cast("long").alias("unit")
        levels.append(scratch.write(levels[-1].groupBy("source_no", parent).agg(F.sum("blocks").alias("blocks"))))
        widest //= fan_out
    won = quotas.select("source_no", F.lit(0).cast("long").alias("parent"), F.col("won").alias("seats"))
    for level in reversed(levels):
        rows = level.withColumns({"parent": F.floor(F.col("unit") / fan_out).cast("long"), "limit": F.col("blocks") * most})
        rows = rows.join(won, ["source_no", "parent"])
        level = scratch.write(apportion(rows, ["source_no", "parent"], "unit", "blocks", "seats", "limit").select("source_no", "unit", "blocks", "won"))
        won = level.select("source_no", F.col("unit").alias("parent"), F.col("won").alias("seats"))
    return level


def mixed_texts(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """doc_id, part, text: what the mix holds. ``docs``: doc_id (no two rows alike), text; ``mixed``: what ``mix`` gave.

    Whole texts stand as they are, once a round; arcs are their words joined by one space. Null ids are left out.
    """
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    whole = F.transform(F.sequence(F.lit(1).cast("long"), F.col("rounds")), lambda _: F.col("text"))
    whole = F.when(F.col("rounds") > 0, whole).otherwise(F.array().cast("array<string>"))
    cut = F.transform("arcs", lambda a: F.concat_ws(" ", F.slice("words", (a["start"] + 1).cast("int"), (a["end"] - a["start"]).cast("int"))))
    rows = docs.select("doc_id", "text").join(mixed.where("taken > 0").select("doc_id", "rounds", "arcs"), "doc_id")
    rows = rows.withColumn("words", F.when(F.size("arcs") > 0, words))
    return rows.select("doc_id", F.posexplode(F.concat(whole, cut)).alias("part", "text"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of ``documents``: how many of its words a mix of weights 1, 2, 3 takes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


#: Mirrors the parameters of ``mix``: blocks of 16 words, shards of 65,536 words or 256 documents (fewer than 1,000 a source).
OP13_SQL = r"""
WITH RECURSIVE rows AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM rows GROUP BY source
), weighed AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS source_no FROM sums
), limits AS (
  SELECT *, CAST((source_no - 1) % 3 + 1 AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) * 3 AS lim FROM weighed
), shares AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY lim / weight, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
  FROM limits
), sources AS (
  SELECT source, source_no, source_size, least(lim, weight * (SELECT arg_min(share, (lim / weight, source_no)) FROM shares WHERE share <= lim / weight)) AS target,
         greatest(1, CAST(ceil(source_size / 65536.0) AS BIGINT), CAST(ceil(n_docs / 256.0) AS BIGINT)) AS n_shards
  FROM shares
), numbered AS (
  SELECT r.doc_id, r.size, s.source_no, s.source_size, s.target, s.n_shards,
         row_number() OVER (PARTITION BY r.doc_id, r.source, r.size) AS copy
  FROM rows r JOIN sources s ON r.source IS NOT DISTINCT FROM s.source
), hashed AS (
  SELECT *, md5('13:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || copy) AS h FROM numbered
), placed AS (
  SELECT *, CAST('0x' || substr(h, 1, 12) AS BIGINT) % n_shards AS shard, CAST('0x' || substr(h, 13, 12) AS BIGINT) AS place FROM hashed
), leaves AS (
  SELECT source_no, shard, CAST(ceil(sum(size) / 16.0) AS BIGINT) AS blocks FROM placed GROUP BY ALL
), quotients AS (
  SELECT s.source_no, s.target / (2 * k - 1) AS q
  FROM (SELECT source_no, any_value(target) AS target, sum(blocks) * 3 AS lim FROM leaves JOIN sources USING (source_no) GROUP BY source_no) s,
       LATERAL (SELECT unnest(range(1, CAST(lim AS BIGINT) + 1)) AS k)
), seats AS (
  SELECT source_no, count(*) AS won FROM (
    SELECT source_no, row_number() OVER (ORDER BY q DESC, source_no) AS r FROM quotients WHERE q > 0
  ) WHERE r <= (SELECT CAST(round(sum(source_size) / 16.0) AS BIGINT) FROM sums) GROUP BY source_no
), shard_seats AS (
  SELECT source_no, shard, count(*) AS won FROM (
    SELECT l.source_no, shard, row_number() OVER (PARTITION BY l.source_no ORDER BY blocks / (2 * k - 1) DESC, shard) AS r
    FROM leaves l, LATERAL (SELECT unnest(range(1, 3 * blocks + 1)) AS k)
  ) JOIN seats USING (source_no) WHERE r <= seats.won GROUP BY source_no, shard
), laid AS (
  SELECT p.*, l.blocks, coalesce(q.won, 0) AS won,
         CAST('0x' || substr(md5('13:arc:' || p.source_no || ':' || p.shard), 1, 12) AS BIGINT) % greatest(l.blocks, 1) * 16 AS a,
         CAST(sum(size) OVER (PARTITION BY p.source_no, p.shard ORDER BY place, doc_id NULLS FIRST, size, copy ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e
  FROM placed p JOIN leaves l USING (source_no, shard) LEFT JOIN shard_seats q USING (source_no, shard)
), arcs AS (
  SELECT *, CASE WHEN blocks > 0 THEN won // blocks ELSE 0 END AS rounds, a + CASE WHEN blocks > 0 THEN won % blocks ELSE 0 END * 16 AS z FROM laid
)
SELECT doc_id, size, source_size, target,
       CAST(rounds * size + greatest(0, least(e, least(z, blocks * 16)) - greatest(e - size, a)) + greatest(0, least(e, z - blocks * 16) - (e - size)) AS BIGINT) AS taken
FROM arcs
"""
