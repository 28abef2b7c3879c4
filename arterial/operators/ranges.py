"""Orders over all rows without one task that holds them: range partitions, and sums over the partitions before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import broadcast_within, settle


def placed(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Add ``_part``, a range of rows in order of ``keys`` and ``order``, and ``_at``, which ascends in that order; settled, so that both stay when a stage runs again."""
    ordered = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    return settle(ordered.withColumns({"_at": F.monotonically_increasing_id(), "_part": F.spark_partition_id()}))


def parts(rows: DataFrame, keys: list[str], *more) -> DataFrame:
    """``keys, _part``, the rows of a key in a part (``_n``), in the parts before (``_before``) and its first ``_at``, with further aggregates ``more``; settled."""
    out = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"), *more)
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    return settle(out.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))))


def joined(rows: DataFrame, sums: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of :func:`parts`; null keys meet."""
    renamed = sums.withColumnsRenamed({c: f"_k_{c}" for c in [*keys, "_part"]})
    same = F.col("_part") == F.col("_k__part")
    for k in keys:
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(broadcast_within(renamed, 64), same).drop(*[f"_k_{c}" for c in [*keys, "_part"]])


def numbered(rows: DataFrame, keys: list[str], *order: str, name: str = "rank") -> DataFrame:
    """Add a row's place in its key, from 1."""
    at = placed(rows, keys, *order)
    both = joined(at, parts(at, keys), keys)
    return both.withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + 1).select(*rows.columns, name)


#: Split points of a pass, and the rows up to which a range is ordered.
SPLITS, FEW = 64, 100_000


def _bits(x: float) -> int:
    """An integer that orders as the number does."""
    import struct

    (n,) = struct.unpack("<q", struct.pack("<d", x))
    return n if n >= 0 else -(n & 0x7FFFFFFFFFFFFFFF)


def _number(n: int) -> float:
    import struct

    return struct.unpack("<d", struct.pack("<q", n if n >= 0 else -(1 << 63) | -n))[0]


def value_at(values: DataFrame, column: str, rank: int) -> float | None:
    """The value at ``rank``, counted from 1 from the greatest down; nulls and NaN are left out, None where there are fewer.

    Each pass counts rows between split points that are even in the numbers' bit patterns,
    so the range that holds the rank has a 64th of the patterns of the last one, whatever
    the tail; a pass shuffles SPLITS counts.  It ends with a range of one value or of FEW
    rows, and only these are ordered.
    """
    v = values.select(F.col(f"`{column}`").cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    n, low, high = v.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not 1 <= rank <= n:
        return None
    while low < high and n > FEW:
        a, b = _bits(low), _bits(high)
        limits = sorted({_number(a + (b - a) * i // SPLITS) for i in range(1, SPLITS + 1)} - {low})
        at = F.size(F.filter(F.array(*[F.lit(x) for x in limits]), lambda s: s <= F.col("v")))
        rows = v.where(F.col("v").between(low, high)).groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy(F.desc("at")).collect()
        for r in rows:
            if rank <= r["n"]:
                n, low, high = r["n"], r["low"], r["high"]
                break
            rank -= r["n"]
    if low == high:
        return low
    return v.where(F.col("v").between(low, high)).orderBy(F.desc("v")).offset(rank - 1).limit(1).first()[0]
