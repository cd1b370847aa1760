"""Point-in-time membership: the latest snapshot that a decision could know."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _headers(decisions: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Each distinct decision date with the latest snapshot date not after it.

    Only dates take part, so this is small whatever the number of symbols.  Dates are
    cut into decades: within one the last snapshot is carried forward, and from one to
    the next only its last snapshot.
    """
    both = decisions.select(F.col("date"), F.lit(None).cast("date").alias("snapshot_date"), F.lit(1).alias("kind")).distinct().unionByName(snapshots.select(F.col("snapshot_date").alias("date"), "snapshot_date", F.lit(0).alias("kind")).distinct())
    cut = both.where("date is not null").withColumn("decade", F.floor(F.year("date") / 10))
    own = F.last("snapshot_date", ignorenulls=True).over(Window.partitionBy("decade").orderBy("date", "kind"))
    last = cut.groupBy("decade").agg(F.max("snapshot_date").alias("last"))
    carried = last.select("decade", F.max("last").over(Window.orderBy("decade").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    return cut.withColumn("own", own).where("kind = 1").join(F.broadcast(carried), "decade").select("date", F.coalesce("own", "carried").alias("snapshot_date"))


def _check(snapshots: DataFrame, max_age_days: int) -> None:
    if max_age_days < 0:
        raise ValueError("the largest age must not be negative")
    if snapshots.groupBy("snapshot_date").count().where("count > 1").limit(1).count():
        raise ValueError("snapshot dates must be distinct")


def audit_membership(members: DataFrame, snapshots: DataFrame, decisions: DataFrame, max_age_days: int) -> DataFrame:
    """One row for each decision date: covered or why not, and how many symbols.

    ``members``: (snapshot_date, symbol); ``snapshots``: a row for each snapshot date,
    also of empty ones, which cover with 0 symbols.
    """
    _check(snapshots, max_age_days)
    dated = _headers(decisions, snapshots).withColumn("age", F.datediff("date", "snapshot_date"))
    size = members.groupBy("snapshot_date").agg(F.countDistinct("symbol").alias("symbols"))
    old = F.col("age") > max_age_days
    reason = F.when(F.col("snapshot_date").isNull(), "before_first_snapshot").when(old, "snapshot_too_old").otherwise("")
    return dated.withColumn("reason", reason).join(size, "snapshot_date", "left").select(
        "date", (F.col("reason") == "").alias("covered"), "snapshot_date", F.col("age").alias("snapshot_age_days"), F.when(F.col("reason") == "", F.coalesce("symbols", F.lit(0))).otherwise(0).alias("membership_symbol_count"), "reason"
    )


def resolve_membership(members: DataFrame, snapshots: DataFrame, decisions: DataFrame, max_age_days: int) -> DataFrame:
    """One row for each decision date and symbol of its snapshot."""
    _check(snapshots, max_age_days)
    dated = _headers(decisions, snapshots).withColumn("membership_snapshot_age_days", F.datediff("date", "snapshot_date")).where(F.col("membership_snapshot_age_days") <= max_age_days)
    joined = members.select("snapshot_date", "symbol").distinct().join(dated, "snapshot_date")
    return joined.select("date", "symbol", F.col("snapshot_date").alias("membership_snapshot_date"), "membership_snapshot_age_days")


def future_rows(resolved: DataFrame, known: str = "membership_snapshot_date", decided: str = "date") -> DataFrame:
    """Rows that know more than their decision could; empty for every sound join."""
    return resolved.where(F.col(known) > F.col(decided))


def assert_no_future(resolved: DataFrame, known: str = "membership_snapshot_date", decided: str = "date") -> DataFrame:
    if future_rows(resolved, known, decided).limit(1).count():
        raise ValueError(f"{known} lies after {decided}")
    return resolved
