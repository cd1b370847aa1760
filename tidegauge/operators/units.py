"""Units of work and runs: what is left to do, how runs stand, whether progress regressed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATES = ("planned", "running", "succeeded", "failed", "blocked", "unavailable", "stopped")
BLOCKING = ("failed", "blocked", "unavailable", "stopped")


def units_to_do(plan: DataFrame, sealed: DataFrame) -> DataFrame:
    """Planned (binding, unit) that are not sealed under the same binding."""
    return plan.join(sealed.select("binding", "unit"), ["binding", "unit"], "left_anti")


def units_reused(plan: DataFrame, sealed: DataFrame) -> DataFrame:
    return plan.join(sealed.select("binding", "unit"), ["binding", "unit"], "left_semi")


def latest(rows: DataFrame, keys: tuple[str, ...], clock: str) -> DataFrame:
    """The last row of each key; of equal clocks, the one that compares largest."""
    others = [c for c in rows.columns if c not in keys]
    top = rows.groupBy(*keys).agg(F.max(F.struct(F.col(clock), *[c for c in others if c != clock])).alias("_top"))
    return top.select(*keys, *[F.col(f"_top.{c}").alias(c) for c in others])


def run_status(stages: DataFrame) -> DataFrame:
    """Stages of each run by state, whether it is complete or settled, and what blocks it."""
    counted = stages.groupBy("run_id").pivot("status", list(STATES)).count()
    counts = [F.coalesce(F.col(s), F.lit(0)).alias(s) for s in STATES]
    blocking = stages.groupBy("run_id").agg(F.sort_array(F.collect_list(F.when(F.col("status").isin(*BLOCKING), F.col("stage")))).alias("blocking_stages"))
    wide = counted.select("run_id", *counts).join(blocking, "run_id")
    open_ = F.col("planned") + F.col("running")
    done = F.col("succeeded") == sum((F.col(s) for s in STATES[1:]), F.col(STATES[0]))
    return wide.withColumns({"execution_complete": done, "settled": open_ == 0})


def batch_rollup(jobs: DataFrame, keys: tuple[str, ...] = ("plan", "role")) -> DataFrame:
    """Jobs of each plan (and role) by outcome: (.., status, reused)."""
    ok = F.col("status") == "succeeded"
    found = jobs.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(ok).alias("finished"), F.count_if(ok & F.coalesce("reused", F.lit(False))).alias("reused"), F.count_if(F.col("status") == "failed").alias("failed"))
    return found.withColumn("pending", F.col("total") - F.col("finished") - F.col("failed")).withColumn("complete", F.col("finished") == F.col("total"))


def progress(log: DataFrame) -> DataFrame:
    """The last good reading of each attempt (attempt, seq, completed_units) and whether
    readings ever fell or were negative."""
    before = F.lag("completed_units").over(Window.partitionBy("attempt").orderBy("seq"))
    bad = F.coalesce(F.col("completed_units") < F.coalesce(before, F.lit(0)), F.lit(True)) | (F.col("completed_units") < 0)
    return log.withColumn("bad", bad).groupBy("attempt").agg(F.max(F.when(F.col("completed_units") >= 0, F.col("completed_units"))).alias("last_good"), F.bool_or("bad").alias("nonmonotonic_progress"))
