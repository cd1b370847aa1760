"""False discovery rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.ordering import placed, same_keys
from tidegauge.operators.returns import finite


def benjamini_hochberg(tests: DataFrame, family: tuple[str, ...], p: str = "p_value", q: str = "q_value") -> DataFrame:
    """Adds the step-up q-value of each test in its family; null where p is missing,
    which does not count as a test.

    A scan over ranges of p: places come forward from the counts of ranges, and each
    range passes its least value on to those before it.  So a family of all rows lies in
    many tasks.
    """
    ranked = placed(tests.where(finite(p)), family, (p,))
    ranked = ranked.withColumn("_step", F.col(p) * F.col("_total") / (F.col("_place") + 1))
    later = Window.partitionBy(*family).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    least = ranked.groupBy(*family, "_part").agg(F.min("_step").alias("_least")).withColumn("_least", F.min("_least").over(later))
    onward = Window.partitionBy(*family, "_part").orderBy(F.desc("_place")).rowsBetween(Window.unboundedPreceding, 0)
    found = same_keys(ranked.withColumn("_own", F.min("_step").over(onward)), least, [*family, "_part"])
    stepped = found.select(*tests.columns, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.least("_own", "_least"))).alias(q))
    return stepped.unionByName(tests.where(~finite(p)).withColumn(q, F.lit(None).cast("double")))


def step_up(tests: DataFrame, family: tuple[str, ...], p: str = "p_value", q: str = "q_value") -> DataFrame:
    """The same for families that the caller knows to be small, such as the lags of a
    series: one window for each."""
    counted = finite(F.col(p))
    w = Window.partitionBy(*family, counted)
    place, m = F.row_number().over(w.orderBy(p)), F.count("*").over(w)
    stepped = tests.withColumn("_m", F.col(p) * m / place).withColumn("_n", place)
    least = F.min("_m").over(w.orderBy("_n").rowsBetween(0, Window.unboundedFollowing))
    return stepped.withColumn(q, F.when(counted, F.least(F.lit(1.0), F.greatest(F.lit(0.0), least)))).drop("_m", "_n")
