"""Cross-sections: leakage-safe columns and rank scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.returns import finite

# Parts of a name, and whole names, that features must not have.
FORBIDDEN_TOKENS = ("entry", "exit", "future", "label", "lead", "target")
FORBIDDEN_FIELDS = (
    "available_margin_cny", "capital_basis_cny", "cash_available_cny", "controlled_position_market_value_cny",
    "controlled_symbols", "financing_payable_cny", "project_controllable_notional_cny", "risk_capital_basis_cny",
)


def forbidden(name: Column) -> Column:
    plain = F.replace(F.lower(F.trim(name)), F.lit("-"), F.lit("_"))
    return F.arrays_overlap(F.split(plain, "_"), F.array(*map(F.lit, FORBIDDEN_TOKENS))) | plain.isin(*FORBIDDEN_FIELDS)


def audit_features(catalog: DataFrame) -> DataFrame:
    """For each dataset of a catalog (dataset, column): counts, what is forbidden and
    what comes twice, what is allowed, and whether it passes."""
    each = catalog.groupBy("dataset", "column").agg(F.count("*").alias("n")).withColumn("bad", forbidden(F.col("column")))
    some = lambda condition: F.sort_array(F.collect_set(F.when(condition, F.col("column"))))
    found = each.groupBy("dataset").agg(F.sum("n").alias("feature_count"), F.sum(F.when(F.col("bad"), 1).otherwise(0)).alias("forbidden_feature_count"), some(F.col("bad")).alias("forbidden_features"), some(F.col("n") > 1).alias("duplicate_features"), some(~F.col("bad")).alias("allowed_features"))
    return found.withColumn("pass", (F.size("forbidden_features") == 0) & (F.size("duplicate_features") == 0))


def _of(df: DataFrame):
    names = df.sparkSession.createDataFrame([("", c) for c in df.columns], "dataset string, column string")
    return audit_features(names).first()


def allowed_features(df: DataFrame) -> DataFrame:
    """The frame with only the columns that may be features, sorted by name."""
    found = _of(df)
    return df.select(*[F.col(f"`{c}`") for c in (found.allowed_features if found else [])])


def assert_features(df: DataFrame) -> DataFrame:
    found = _of(df)
    if found and not found["pass"]:
        raise ValueError(f"forbidden features {found.forbidden_features}, repeated {found.duplicate_features}")
    return df


def rank_score(panel: DataFrame, value: str = "value", date: str = "date", higher_is_better: bool = True) -> DataFrame:
    """Adds score: the average-tie percentile rank among the date's values, less one
    half; 0 where value or date is missing.

    Values are counted for each date first; ranks run over distinct values, so a
    crowded date costs its distinct values and not its rows.
    """
    clean = panel.withColumn("_v", F.when(finite(F.col(value).cast("double")) | (F.abs(F.col(value).cast("double")) == float("inf")), F.col(value).cast("double")))
    counted = clean.where(F.col("_v").isNotNull() & F.col(date).isNotNull()).groupBy(F.col(date).alias("_d"), "_v").agg(F.count("*").alias("ties"))
    order = F.col("_v").asc() if higher_is_better else F.col("_v").desc()
    w = Window.partitionBy("_d")
    below = F.coalesce(F.sum("ties").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = counted.select("_d", F.col("_v").alias("_r"), ((below + (F.col("ties") + 1) / 2) / F.sum("ties").over(w) - 0.5).alias("score"))
    joined = clean.join(ranks, (F.col(date) == F.col("_d")) & (F.col("_v") == F.col("_r")), "left")
    return joined.select(*[F.col(f"`{c}`") for c in panel.columns], F.coalesce("score", F.lit(0.0)).alias("score"))
