"""Sequential validation of return series: everything about a candidate in one row."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.calendar import calendar_periods, positive_fraction
from tidegauge.operators.inference import mean_inference
from tidegauge.operators.returns import indexed, path_metrics, prepare_returns, without_best_days
from tidegauge.operators.serial import dependence_diagnostics
from tidegauge.operators.windows import overlapping_windows, summarize_windows

COMPUTED, DIAGNOSTIC = "sequential_multi_origin_stability_computed", "diagnostic_only_causal_signal_path_not_verified"


def _nested(df: DataFrame, name: str, order: list[str] | None = None) -> DataFrame:
    rest = [c for c in df.columns if c != "series"]
    if order is None:
        return df.select("series", F.struct(*rest).alias(name))
    return df.groupBy("series").agg(F.sort_array(F.collect_list(F.struct(*order, *[c for c in rest if c not in order]))).alias(name))


def sequential_validation(raw: DataFrame, horizons: Iterable[int] = (20, 60), overlap_horizon: int = 1, resamples: int = 1000, max_lag: int = 20, verified: bool = False) -> dict[str, DataFrame]:
    """windows, window_summary, calendar and result (one row for each series)."""
    daily = prepare_returns(raw)
    values = indexed(daily).select("series", "idx", F.col("net_return").alias("value"))
    windows = overlapping_windows(daily, horizons)
    summary, calendar = summarize_windows(windows), calendar_periods(daily)
    _, flags = dependence_diagnostics(values, max_lag)
    result = daily.groupBy("series").agg(F.min("date").alias("date_min"), F.max("date").alias("date_max"))
    parts = [
        _nested(path_metrics(daily), "full_period_metrics"), _nested(without_best_days(daily), "without_best_days"), _nested(mean_inference(values, overlap_horizon, resamples=resamples), "inference"),
        _nested(flags, "serial_dependence"), _nested(summary, "window_summary", ["horizon"]), _nested(positive_fraction(calendar), "calendar_positive_fraction", ["period_kind"]),
    ]
    for part in parts:
        result = result.join(part, "series", "left")
    return {"windows": windows, "window_summary": summary, "calendar": calendar, "result": result.withColumn("status", F.lit(COMPUTED if verified else DIAGNOSTIC))}


def report_lines(result: DataFrame) -> DataFrame:
    """One text for each series, to read."""
    full = F.col("full_period_metrics")
    number = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(F.format_string("%.6f", c), F.lit("none")))
    lines = [F.concat(F.lit("series: "), F.col("series").cast("string")), F.concat(F.lit("status: "), F.col("status")), F.concat_ws(" ", F.lit("dates:"), F.col("date_min").cast("string"), F.lit("to"), F.col("date_max").cast("string"))]
    lines += [number(n, full[n]) for n in ("total_return", "annualized_return", "annualized_volatility", "sharpe", "max_drawdown", "win_rate")]
    per = F.transform("window_summary", lambda w: F.format_string("horizon %d: %d windows, %.4f gained, median %.6f", w["horizon"], w["window_count"], w["positive_window_fraction"], w["median_total_return"]))
    return result.select(F.array_join(F.concat(F.array(*lines), F.coalesce(per, F.array().cast("array<string>"))), "\n").alias("value"))


def write_validation(found: dict[str, DataFrame], path: str) -> None:
    """Tables as CSV by series, the result as one JSON document a row, and the report."""
    for name in ("windows", "window_summary", "calendar"):
        found[name].repartition("series").sortWithinPartitions("series").write.mode("overwrite").option("header", True).partitionBy("series").csv(f"{path}/{name}")
    found["result"].write.mode("overwrite").json(f"{path}/result")
    report_lines(found["result"]).write.mode("overwrite").text(f"{path}/report")
