"""Metrics of all overlapping windows of a series, and their summary."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.ordering import placed
from tidegauge.operators.returns import PERIODS, indexed

#: Observations of a series whose windows end in one task.
BUCKET = 4096


def with_halo(rows: DataFrame, size: int, halo: int) -> DataFrame:
    """Rows dealt to buckets of ``size`` places of their series; the last ``halo`` rows
    of a bucket also stand before the next one."""
    own = F.floor(F.col("idx") / size)
    return rows.withColumn("bucket", F.explode(F.when(F.col("idx") % size >= size - halo, F.array(own, own + 1)).otherwise(F.array(own))))


def _joined(a: Column, b: Column, n_a: int, n_b: int) -> Column:
    """What is known of ``n_a`` rows followed by ``n_b`` rows.

    Known of rows: mean and m2 (squares about it), worst, best and wins of the returns;
    grown, low and high of the curve from 1 before them, and fall, its largest drop from
    a peak within them.
    """
    n, step = n_a + n_b, b["mean"] - a["mean"]
    both = F.struct(
        (a["mean"] + step * (n_b / n)).alias("mean"), (a["m2"] + b["m2"] + step * step * (n_a * n_b / n)).alias("m2"), F.least(a["worst"], b["worst"]).alias("worst"), F.greatest(a["best"], b["best"]).alias("best"), (a["wins"] + b["wins"]).alias("wins"),
        (a["grown"] * b["grown"]).alias("grown"), F.least(a["low"], a["grown"] * b["low"]).alias("low"), F.greatest(a["high"], a["grown"] * b["high"]).alias("high"), F.least(a["fall"], b["fall"], a["grown"] * b["low"] / a["high"] - 1).alias("fall"),
    )
    return F.when(a.isNotNull(), both)


def overlapping_windows(daily: DataFrame, horizons: Iterable[int], periods: int = PERIODS) -> DataFrame:
    """One row for each series, horizon and end: the path metrics of the last
    ``horizon`` observations.

    A series is cut into buckets that carry the observations before them.  What is known
    of the last 1, 2, 4, ... rows is joined from that of half as many, and a
    horizon from those powers of two that make it up: so a window costs the logarithm of its
    horizon, and one ordering serves all of them.
    """
    wanted = sorted(set(map(int, horizons)))
    if not wanted or wanted[0] <= 0:
        raise ValueError("horizons must be positive")
    size = max(BUCKET, 4 * wanted[-1])
    order = Window.partitionBy("series", "bucket").orderBy("idx")
    r = F.col("net_return")
    one = F.struct(r.alias("mean"), F.lit(0.0).alias("m2"), r.alias("worst"), r.alias("best"), (r > 0).cast("long").alias("wins"), *[(1 + r).alias(c) for c in ("grown", "low", "high")], F.lit(0.0).alias("fall"))
    out = with_halo(indexed(daily), size, wanted[-1] - 1).select("series", "bucket", "idx", "date", one.alias("last_1"))
    n = 1
    while 2 * n <= wanted[-1]:
        out = out.withColumn("before", F.lag(f"last_{n}", n).over(order))
        out, n = out.withColumn(f"last_{2 * n}", _joined(F.col("before"), F.col(f"last_{n}"), n, n)), 2 * n
    for h in wanted:
        bits = [1 << k for k in range(h.bit_length()) if h >> k & 1]
        out, covered = out.withColumn(f"window_{h}", F.col(f"last_{bits[0]}")), bits[0]
        for bit in bits[1:]:
            out = out.withColumn("before", F.lag(f"last_{bit}", covered).over(order))
            out, covered = out.withColumn(f"window_{h}", _joined(F.col("before"), F.col(f"window_{h}"), bit, covered)), covered + bit
    out = out.withColumns({f"start_{h}": F.lag("date", h - 1).over(order) for h in wanted})
    own = out.where(F.floor(F.col("idx") / size) == F.col("bucket"))
    each = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"start_{h}").alias("start_date"), F.col(f"window_{h}").alias("w")) for h in wanted])
    stacked = own.select("series", F.col("date").alias("end_date"), "idx", F.inline(each)).where("idx + 1 >= horizon")
    w = lambda c: F.col(f"w.{c}")
    spread = F.when((F.col("horizon") > 1) & (w("worst") < w("best")), F.sqrt(w("m2") / (F.col("horizon") - 1))).otherwise(0.0)
    return stacked.select(
        "series", "horizon", "start_date", "end_date", F.col("horizon").cast("long").alias("observations"), (w("grown") - 1).alias("total_return"),
        (F.pow(w("grown"), periods / F.col("horizon")) - 1).alias("annualized_return"), (spread * periods**0.5).alias("annualized_volatility"),
        F.when(spread > 0, w("mean") / spread * periods**0.5).alias("sharpe"), F.least(F.lit(0.0), w("fall"), w("low") - 1).alias("max_drawdown"), w("worst").alias("worst_day"), (w("wins") / F.col("horizon")).alias("win_rate"),
    )


def summarize_windows(windows: DataFrame) -> DataFrame:
    """One row for each series and horizon.

    Percentiles are exact and interpolated: values are dealt by ranges and get their
    places, and the one or two at a percentile's place are added up by their weights, so
    no group's values come together anywhere.
    """
    kinds = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in ("total_return", "sharpe")])
    each = windows.select("series", "horizon", "end_date", "max_drawdown", F.inline(kinds)).where("value is not null")
    rows = placed(each, ("series", "horizon", "metric"), ("value",))
    of = lambda c: F.when(F.col("metric") == "total_return", c)

    def percentile(metric: str, p: float) -> Column:
        at = p * (F.col("_total") - 1)
        weight = F.when(F.col("_place") == F.floor(at), 1 - (at - F.floor(at))).when(F.col("_place") == F.floor(at) + 1, at - F.floor(at))
        return F.sum(F.when(F.col("metric") == metric, F.col("value") * weight))

    value = of(F.col("value"))
    return rows.groupBy("series", "horizon").agg(
        F.count(value).alias("window_count"), F.avg((value > 0).cast("double")).alias("positive_window_fraction"), F.avg(value).alias("mean_total_return"),
        percentile("total_return", 0.5).alias("median_total_return"), F.min(value).alias("minimum_total_return"), percentile("total_return", 0.1).alias("p10_total_return"),
        percentile("total_return", 0.9).alias("p90_total_return"), F.max(value).alias("maximum_total_return"), percentile("sharpe", 0.5).alias("median_sharpe"),
        F.min(of(F.col("max_drawdown"))).alias("worst_window_drawdown"), F.max("end_date").alias("latest_window_end_date"), F.max_by(value, of(F.col("end_date"))).alias("latest_window_total_return"),
    )
