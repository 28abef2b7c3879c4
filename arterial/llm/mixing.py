"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a target number of words.  Whole epochs of the source come first;
the rest is filled by documents in ascending order of exponential keys,
``-ln(u) / quality weight``, until the prefix sum of their sizes reaches the budget.

The prefix sum is distributed: keys fall into ranges of equal probability, range
totals are summed before the shuffle, and only the one range per source in which
the budget ends is ordered row by row, so a source with any share of the rows costs
no task more than others.

Defined results: null text has size 0; the null source is one source, ordered last;
weights follow the position of the source; null or non-positive quality weights
count as 1; equal keys are ordered by id, then size; rows with a null id take part;
an empty table gives an empty result; the same rows give the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Key ranges per source; the one in which a budget ends holds about 1/RANGES of the source.
RANGES = 4096
#: Largest number of sources whose targets are broadcast, under 100 bytes each.
MAX_BROADCAST_SOURCES = 100_000


def words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text, 0 for null: blanks that are followed by a word, counted without building a list."""
    spaced = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.filter(F.split(spaced, " "), lambda w: w != "")).cast("long"), F.lit(0).cast("long"))


def uniform(id_col: Column) -> Column:
    """A number in (0, 1) that depends on the id's text only."""
    digits = F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``source, source_size, target`` of each source from ``source, source_size``.

    The budget, ``share`` times the sum of all sizes, is dealt by weight; no target
    exceeds ``most`` times the source's size, and the excess is dealt again among the
    others.  Sorted by size per weight, the sources that are capped come first, so a
    prefix sum finds the level at which the rest share the remainder.  One row for
    each source: this table is as small as the catalogue of sources.
    """
    everything = W.partitionBy()
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("weight", F.element_at(table, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    s = s.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    # capped while the level offers at least the cap; from the first that is not, the level holds for all
    s = s.withColumn("free_level", F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything))
    offer = F.coalesce(F.col("free_level.level") * F.col("weight"), F.col("cap"))
    return s.select("source", "source_size", F.least("cap", offer).alias("target"))


def mix(docs: DataFrame, id_col: str, size: Column, source_col: str, quality: Column, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``id_col, size, source_size, target, taken`` of every row of ``docs``; ``size`` and ``quality`` are columns over ``docs``."""
    q = F.when(quality > 0, quality).otherwise(F.lit(1.0)).cast("double")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), F.coalesce(size, F.lit(0)).cast("long").alias("size"), (-F.ln(uniform(F.col(f"`{id_col}`"))) / q).alias("k"))
    # any increasing map of the key onto [0, 1) will do: this one fills the ranges evenly where weights are 1
    rows = rows.withColumn("r", F.least(F.floor((F.lit(1.0) - F.exp(-F.col("k"))) * RANGES), F.lit(RANGES - 1)).cast("int"))
    parts = rows.groupBy("source", "r").agg(F.sum("size").alias("part"))
    goal = targets(parts.groupBy("source").agg(F.sum("part").alias("source_size")), weights, share, most)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    ranges = parts.join(goal.withColumnRenamed("source", "gs"), F.col("source").eqNullSafe(F.col("gs"))).drop("gs")
    before = F.coalesce(F.sum("part").over(W.partitionBy("source").orderBy("r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.withColumn("before", before)
    # whole: the range fits; open: the budget ends in it
    ranges = ranges.withColumn("state", F.when(F.col("before") + F.col("part") <= F.col("rest"), F.lit(2)).when(F.col("before") < F.col("rest"), F.lit(1)).otherwise(0))
    edge = ranges.groupBy("source", "source_size", "target", "epochs", "rest").agg(F.min(F.when(F.col("state") < 2, F.col("r"))).alias("edge"), F.min(F.when(F.col("state") < 2, F.struct("r", "before")))["before"].alias("edge_before"))
    # one row per source: broadcast where there are few, else joined with hot sources split by Spark
    edge = edge.withColumnRenamed("source", "gs")
    if docs.select(F.approx_count_distinct(f"`{source_col}`")).first()[0] <= MAX_BROADCAST_SOURCES:
        edge = F.broadcast(edge)
    joined = rows.join(edge, F.col("source").eqNullSafe(F.col("gs"))).drop("gs")
    inside = (F.col("r") == F.col("edge")) & (F.col("edge_before") < F.col("rest"))
    upto = F.sum("size").over(W.partitionBy("source").orderBy("k", "id", "size").rowsBetween(W.unboundedPreceding, 0)) + F.col("edge_before")
    # nearest: the document in which the budget ends is in if at least half of it fits
    ordered = joined.where(inside).withColumn("chosen", (upto - F.col("size") / 2 <= F.col("rest")).cast("long"))
    other = joined.where(~inside | F.col("edge").isNull()).withColumn("chosen", F.when(F.col("edge").isNull() | (F.col("r") < F.col("edge")), 1).otherwise(0).cast("long"))
    other = other.withColumn("chosen", F.when(F.col("rest") > 0, F.col("chosen")).otherwise(0))
    taken = F.col("size") * (F.col("epochs") + F.col("chosen"))
    return ordered.unionByName(other).select(F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"))


def oracle(quality_sql: str, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, rows: str = "documents") -> str:
    """DuckDB SQL of :func:`mix` over ``rows`` for ``quality_sql``, a query of (doc_id, q); sorts each source whole."""
    case = " ".join(f"WHEN {i} THEN {float(w)}" for i, w in enumerate(weights))
    return f"""
WITH sized AS (
  SELECT d.doc_id, d.source, coalesce(len(list_filter(string_split(translate(d.text, chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '     '), ' '), lambda w: w <> '')), 0)::BIGINT AS size,
         -ln((('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE) / coalesce(q.q, 1.0) AS k
  FROM {rows} d LEFT JOIN ({quality_sql}) q ON q.doc_id = d.doc_id),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} {case} END AS weight, source_size * {float(most)} AS cap, {float(share)} * sum(source_size) OVER () AS budget FROM s),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT first(level ORDER BY cap / weight) FILTER (WHERE level * weight < cap) AS level FROM l),
t AS (SELECT l.source, l.source_size, least(l.cap, coalesce(f.level * l.weight, l.cap)) AS target FROM l, f),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
c AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.epochs, g.target - g.epochs * g.source_size AS rest,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM sized d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN rest > 0 AND upto - size / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM c"""
