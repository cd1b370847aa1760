"""Metrics for each calendar year and quarter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.returns import PERIODS, path_metrics

KEYS = ("series", "period_kind", "period")


def calendar_rows(daily: DataFrame) -> DataFrame:
    year, quarter = F.year("date").cast("string"), F.concat(F.year("date").cast("string"), F.lit("Q"), F.quarter("date").cast("string"))
    kinds = F.array(F.struct(F.lit("calendar_year").alias("period_kind"), year.alias("period")), F.struct(F.lit("calendar_quarter").alias("period_kind"), quarter.alias("period")))
    return daily.select("*", F.inline(kinds))


def calendar_periods(daily: DataFrame, periods: int = PERIODS) -> DataFrame:
    """Path metrics and first and last date of each series, kind and period."""
    rows = calendar_rows(daily)
    ends = rows.groupBy(*KEYS).agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"))
    return path_metrics(rows, KEYS, periods).join(ends, list(KEYS))


def positive_fraction(periods: DataFrame) -> DataFrame:
    """Fraction of periods that gained, for each series and kind."""
    return periods.groupBy("series", "period_kind").agg(F.avg((F.col("total_return") > 0).cast("double")).alias("positive_fraction"))
