"""Places of rows in an order, for keys of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.sources.tables import stash

#: Rows of one range in one task have numbers that agree above these bits.
RANGE_BITS = 33


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys that may be null; the keys of ``left`` stay."""
    other = right.select(*[F.col(k).alias(f"_right_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    equal = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(other, equal, "left").drop(*[f"_right_{k}" for k in keys])


def placed(rows: DataFrame, keys: Sequence[str], order: Sequence[str], kept: Sequence[str] | None = None) -> DataFrame:
    """Written anew with _part, _place and _total: the range of its key that a row is in,
    its place in its key's order from 0, and the key's rows.  Of the other columns, the
    keys and ``kept`` are written, by default all.

    Rows are dealt by ranges of (keys, order, row), so a key with any share of the rows,
    and any number of equal rows, lies in many tasks.  Rows are numbered as they are
    written, so one's place is its number less the first of its range and key, after
    the counts of the ranges before.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*keys, *order, "_at"]
    dealt = rows.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(n, *by).sortWithinPartitions(*by)
    light = dealt if kept is None else dealt.select(*keys, *[c for c in kept if c not in keys])
    held = stash(light.withColumn("_at", F.monotonically_increasing_id()), "placed").withColumn("_part", F.shiftright("_at", RANGE_BITS))
    parts = held.groupBy(*keys, "_part").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    mine = Window.partitionBy(*keys)
    earlier = mine.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, "_part", "_first", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"), F.sum("_rows").over(mine).alias("_total"))
    # Written, so the size is known to a join that need not deal out the rows.
    found = same_keys(held, stash(parts, "ranges"), [*keys, "_part"])
    return found.withColumn("_place", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_before", "_first")
