"""Return series (series, date, net_return): checks and path metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.ordering import same_keys

PERIODS = 252
#: Days of a stretch of a series whose curve is followed in one task.
STRETCH_DAYS = 1024


def finite(c: Column | str) -> Column:
    """Whether a number is neither null, NaN nor infinite."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def return_violations(raw: DataFrame) -> DataFrame:
    """How many rows of each series break each rule; no row where all is well."""
    typed = _typed(raw)
    once = typed.groupBy("series", "date").agg(F.count("*").alias("n"), F.count_if(F.col("date").isNull()).alias("no_date"), F.count_if(~finite("net_return")).alias("no_return"), F.count_if(F.col("net_return") <= -1).alias("below"))
    found = once.groupBy("series").agg(F.sum("no_date").alias("invalid_dates"), F.sum("no_return").alias("nonfinite_returns"), F.sum("below").alias("returns_at_most_minus_one"), F.count_if(F.col("date").isNotNull() & (F.col("n") > 1)).alias("duplicate_dates"))
    return found.where("invalid_dates + nonfinite_returns + returns_at_most_minus_one + duplicate_dates > 0")


def _typed(raw: DataFrame) -> DataFrame:
    value = F.col("net_return").try_cast("double")
    return raw.select("series", F.col("date").try_cast("timestamp").cast("date").alias("date"), F.when(~F.isnan(value), value).alias("net_return"))


def prepare_returns(raw: DataFrame, verify: bool = True) -> DataFrame:
    """series, date and net_return in their types; an error if any rule is broken."""
    if missing := {"series", "date", "net_return"} - set(raw.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    if verify and (bad := return_violations(raw).limit(5).collect()):
        raise ValueError(f"invalid returns: {[r.asDict() for r in bad]}")
    return _typed(raw)


def finite_rows(values: DataFrame, value: str = "value") -> DataFrame:
    """Drops what is not finite; positions are counted afterwards."""
    return values.where(finite(value))


def nonfinite_series(values: DataFrame, series: str = "series", value: str = "value") -> DataFrame:
    """Series that hold anything not finite, with its number."""
    return values.groupBy(series).agg(F.count_if(~finite(value)).alias("nonfinite")).where("nonfinite > 0")


def indexed(daily: DataFrame, keys: tuple[str, ...] = ("series",), stretch_days: int = STRETCH_DAYS) -> DataFrame:
    """Adds idx, the place of each row in its series from 0.

    Rows are numbered within stretches of days, after the counts of those before, so
    a long series is ordered in many tasks.
    """
    cut = daily.withColumn("stretch", F.floor(F.datediff("date", F.lit("1970-01-01")) / stretch_days))
    earlier = Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy(*keys, "stretch").count().select(*keys, "stretch", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy(*keys, "stretch").orderBy("date"))
    return cut.join(before, [*keys, "stretch"]).withColumn("idx", F.col("before") + place - 1).drop("before", "stretch")


def _stretches(daily: DataFrame, keys: tuple[str, ...], stretch_days: int) -> tuple[DataFrame, DataFrame]:
    """Rows with _own and _top, the curve and its highest value from the start of their
    stretch of days; and (product, low, high, fall) of each stretch."""
    cut = daily.withColumn("_stretch", F.floor(F.datediff("date", F.lit("1970-01-01")) / stretch_days))
    so_far = Window.partitionBy(*keys, "_stretch").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    curve = cut.withColumn("_own", F.product(1 + F.col("net_return")).over(so_far))
    rows = curve.withColumn("_top", F.max("_own").over(so_far))
    return rows, rows.groupBy(*keys, "_stretch").agg(F.max_by("_own", "date").alias("product"), F.min("_own").alias("low"), F.max("_own").alias("high"), F.min(F.col("_own") / F.col("_top") - 1).alias("fall"))


def drawdowns(daily: DataFrame, keys: tuple[str, ...] = ("series",), stretch_days: int = STRETCH_DAYS) -> DataFrame:
    """Adds curve, peak (from 1) and drawdown of each row.

    A scan in two passes: (product, high) of each stretch give the level and the peak
    that the next one starts from, and its rows go on from there.  Only these pairs, one
    for each stretch, follow each other in one task.
    """
    rows, parts = _stretches(daily, keys, stretch_days)
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    level = parts.withColumn("_level", F.coalesce(F.product("product").over(before), F.lit(1.0)))
    start = level.select(*keys, "_stretch", "_level", F.greatest(F.lit(1.0), F.max(F.col("_level") * F.col("high")).over(before)).alias("_peak"))
    found = same_keys(rows, start, [*keys, "_stretch"])
    curve = F.col("_level") * F.col("_own")
    peak = F.greatest("_peak", F.col("_level") * F.col("_top"))
    return found.select(*daily.columns, curve.alias("curve"), peak.alias("peak"), (curve / peak - 1).alias("drawdown"))


def max_drawdown(daily: DataFrame, keys: tuple[str, ...] = ("series",), stretch_days: int = STRETCH_DAYS) -> DataFrame:
    """Largest drawdown of each series, by stretches.

    A stretch is summed up by (product, lowest, highest, own largest drawdown), all
    relative to its start; these four of neighbours combine, so a long series is
    followed in many tasks.
    """
    part = _stretches(daily, keys, stretch_days)[1]
    parts = part.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_stretch", "product", "low", "high", "fall"))).alias("parts"))
    merged = F.expr("""aggregate(parts, named_struct('at', 1D, 'peak', 1D, 'fall', 0D),
        (a, p) -> named_struct('at', a.at * p.product, 'peak', greatest(a.peak, a.at * p.high), 'fall', least(a.fall, p.fall, a.at * p.low / a.peak - 1)), a -> a.fall)""")
    return parts.select(*keys, merged.alias("max_drawdown"))


def path_metrics(daily: DataFrame, keys: tuple[str, ...] = ("series",), periods: int = PERIODS, groups: DataFrame | None = None) -> DataFrame:
    """Metrics of each series; with ``groups`` (the keys) also of those without rows.

    A series whose returns are all the same has no volatility and no ratio.
    """
    spread = F.when((F.count("net_return") > 1) & (F.min("net_return") < F.max("net_return")), F.stddev_samp("net_return")).otherwise(0.0)
    found = daily.groupBy(*keys).agg(
        F.count("net_return").alias("observations"), (F.product(1 + F.col("net_return")) - 1).alias("total_return"), F.avg("net_return").alias("mean_return"), spread.alias("spread"),
        F.min("net_return").alias("worst_day"), F.avg((F.col("net_return") > 0).cast("double")).alias("win_rate"),
    )
    found = found.join(max_drawdown(daily, keys), list(keys)).select(
        *keys, "observations", "total_return",
        (F.pow(1 + F.col("total_return"), periods / F.col("observations")) - 1).alias("annualized_return"),
        (F.col("spread") * periods**0.5).alias("annualized_volatility"),
        F.when(F.col("spread") > 0, F.col("mean_return") / F.col("spread") * periods**0.5).alias("sharpe"),
        "max_drawdown", "worst_day", "win_rate",
    )
    if groups is not None:
        found = groups.select(*keys).distinct().join(found, list(keys), "left").withColumn("observations", F.coalesce("observations", F.lit(0)))
    return found


def without_best_days(daily: DataFrame, days: tuple[int, ...] = (1, 5, 10), keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """Total return of each series without its best k days, for each k; null if no day
    is left, and of all days for a k of 0 or less."""
    best = Window.partitionBy(*keys).orderBy(F.col("net_return").desc())
    # Only the best few rows of a series are ranked; Spark limits each task to them first.
    top = daily.withColumn("place", F.row_number().over(best)).where(F.col("place") <= max(*days, 1, 0))
    tops = top.groupBy(*keys).agg(*[F.product(F.when(F.col("place") <= k, 1 + F.col("net_return"))).alias(f"top_{k}") for k in days])
    whole = daily.groupBy(*keys).agg(F.count("*").alias("n"), F.product(1 + F.col("net_return")).alias("grown")).join(tops, list(keys))
    return whole.select(*keys, *[F.when(F.col("n") > k, F.col("grown") / F.coalesce(f"top_{k}", F.lit(1.0)) - 1).alias(f"without_best_{k}") for k in days])
