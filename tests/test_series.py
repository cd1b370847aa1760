import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.jobs.validation import sequential_validation, write_validation
from tidegauge.operators import calendar, inference, multiplicity, returns, serial, windows


def daily(spark, values, series="a", start=dt.date(2026, 1, 1)):
    return spark.createDataFrame([(series, start + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)], "series string, date date, net_return double")


def indexed(spark, **series):
    return spark.createDataFrame([(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)], "series string, idx long, value double")


def metrics(x):
    curve = np.cumprod(1 + x)
    peak = np.maximum.accumulate(np.r_[1.0, curve])[1:]
    return curve[-1] - 1, min(0.0, (curve / peak - 1).min())


def test_path_metrics_over_stretches(spark):
    x = np.random.default_rng(2).normal(0, 0.02, 300)
    df = daily(spark, x)
    total, fall = metrics(x)
    for days in (7, 100, 5000):
        assert returns.max_drawdown(df, stretch_days=days).first()[1] == pytest.approx(fall, abs=1e-12)
        idx = returns.indexed(df, stretch_days=days).orderBy("date").toPandas()["idx"].tolist()
        assert idx == list(range(300))
    got = returns.path_metrics(df, groups=spark.createDataFrame([("a",), ("empty",)], "series string")).orderBy("series").collect()
    assert got[0].total_return == pytest.approx(total) and got[0].sharpe == pytest.approx(x.mean() / x.std(ddof=1) * math.sqrt(252))
    assert got[1].observations == 0 and got[1].total_return is None
    assert returns.drawdowns(df).agg(F.min("drawdown")).first()[0] == pytest.approx(fall)


def test_constant_returns_have_no_ratio(spark):
    row = returns.path_metrics(daily(spark, [0.01] * 10)).first()
    assert row.sharpe is None and row.annualized_volatility == 0 and row.win_rate == 1


def test_windows_of_constant_returns(spark):
    found = windows.overlapping_windows(daily(spark, [0.01] * 10), [3, 5, 3])
    summary = {r.horizon: r for r in windows.summarize_windows(found).collect()}
    assert summary[3].window_count == 8 and summary[5].window_count == 6 and summary[3].positive_window_fraction == 1
    assert summary[3].median_sharpe is None
    assert windows.overlapping_windows(daily(spark, [0.01] * 2), [3]).count() == 0
    with pytest.raises(ValueError):
        windows.overlapping_windows(daily(spark, [0.0]), [0])


@pytest.mark.parametrize("horizon", [1, 5, 80, 119])
def test_window_drawdowns_across_buckets(spark, monkeypatch, horizon):
    monkeypatch.setattr(windows, "BUCKET", 16)
    x = np.random.default_rng(5).normal(0, 0.02, 700)
    found = windows.overlapping_windows(daily(spark, x), [horizon]).orderBy("end_date").toPandas()
    want = [metrics(x[i : i + horizon]) for i in range(700 - horizon + 1)]
    assert np.allclose(found["total_return"], [w[0] for w in want]) and np.allclose(found["max_drawdown"], [w[1] for w in want])


def test_best_days(spark):
    row = returns.without_best_days(daily(spark, [0.1, -0.2, 0.3]), (0, 1, 3)).first()
    assert row.without_best_0 == pytest.approx(1.1 * 0.8 * 1.3 - 1) and row.without_best_1 == pytest.approx(1.1 * 0.8 - 1) and row.without_best_3 is None


def test_calendar(spark):
    rows = calendar.calendar_periods(daily(spark, [0.01] * 200))
    assert {r.period for r in rows.collect()} == {"2026", "2026Q1", "2026Q2", "2026Q3"}
    assert {r.positive_fraction for r in calendar.positive_fraction(rows).collect()} == {1.0}


def test_preparation_rejects(spark):
    raw = spark.createDataFrame([("a", "2026-01-01", "0.1"), ("a", "2026-01-01", "0.2"), ("b", "x", "-2"), ("b", "2026-01-02", "inf")], "series string, date string, net_return string")
    bad = {r.series: r for r in returns.return_violations(raw).collect()}
    assert bad["a"].duplicate_dates == 1 and bad["b"].invalid_dates == 1 and bad["b"].returns_at_most_minus_one == 1 and bad["b"].nonfinite_returns == 1
    with pytest.raises(ValueError):
        returns.prepare_returns(raw)


def test_hac_of_ar1(spark, monkeypatch):
    g, x = np.random.default_rng(20260808), np.zeros(600)
    for t, e in enumerate(g.normal(size=600)):
        x[t] = 0.85 * x[t - 1] + 0.15 + e
    df = indexed(spark, a=x)
    row = inference.newey_west(df).first()
    c, lag = x - x.mean(), row.hac_lag
    lrv = c @ c / 600 + sum(2 * (1 - k / (lag + 1)) * (c[k:] @ c[:-k]) / 600 for k in range(1, lag + 1))
    assert row.hac_long_run_variance == pytest.approx(lrv) and row.hac_standard_error > row.iid_standard_error and 1 <= row.effective_observations < 360 and row.hac_t_stat < row.iid_t_stat
    assert row.hac_two_sided_p_value == pytest.approx(math.erfc(abs(row.hac_t_stat) / math.sqrt(2)))
    assert len(row.lag_autocorrelations) == lag
    monkeypatch.setattr(inference, "BUCKET", 40)
    assert inference.newey_west(df).first().hac_long_run_variance == pytest.approx(lrv)
    one = inference.newey_west(indexed(spark, a=[0.5])).first()
    assert one.mean == 0.5 and one.hac_t_stat is None
    assert inference.newey_west(indexed(spark, a=np.linspace(-0.02, 0.03, 200)), 12).first().hac_lag >= 11
    assert math.isnan(inference.hac_ratios(inference.newey_west(indexed(spark, a=[0.001] * 5))).first().hac_annualized_ratio)


def test_bootstrap(spark):
    sine = indexed(spark, a=np.sin(np.arange(120)) * 0.01 + 0.001)
    blocks = spark.createDataFrame([("a", 7)], "series string, block_length long")
    first, again = (inference.bootstrap_mean(sine, blocks, 200, 41).first() for _ in range(2))
    assert first == again and first.confidence_interval_low < first.confidence_interval_high and first.available
    short = inference.bootstrap_mean(indexed(spark, a=np.linspace(-0.01, 0.02, 12)), spark.createDataFrame([("a", 12)], "series string, block_length long")).first()
    assert short.unavailable_reasons == ["block_length_not_smaller_than_sample", "too_few_effective_blocks"] and short.two_sided_p_value is None
    flat = inference.bootstrap_mean(indexed(spark, a=[0.001] * 40), spark.createDataFrame([("a", 5)], "series string, block_length long")).first()
    assert "numerically_degenerate_bootstrap_distribution" in flat.unavailable_reasons and flat.mean is None
    with pytest.raises(ValueError):
        inference.bootstrap_mean(sine, blocks, confidence=1.0)
    zeros = inference.audit_distribution(indexed(spark, a=[0.0] * 1000).select("series", "value")).first()
    assert zeros.reasons == ["numerically_degenerate_bootstrap_distribution", "too_few_unique_bootstrap_statistics"]
    both = inference.mean_inference(indexed(spark, a=np.linspace(-0.02, 0.03, 200)), 12, resamples=100).first()
    assert both.hac.hac_lag >= 11 and both.block_bootstrap.block_length >= 12 and both.confirmation_inference_available


def test_false_discovery(spark):
    df = spark.createDataFrame([("f", 0.01), ("f", 0.04), ("f", 0.03), ("f", None), ("g", 0.9)], "family string, p_value double")
    got = [r.q_value for r in multiplicity.benjamini_hochberg(df, ("family",)).orderBy("family", F.col("p_value").asc_nulls_last()).collect()]
    assert got == [pytest.approx(0.03), pytest.approx(0.04), pytest.approx(0.04), None, pytest.approx(0.9)]


def test_diagnostics(spark):
    g = np.random.default_rng(1729)
    noise = g.normal(size=5000)
    shocks = np.random.default_rng(991).normal(size=6001)
    moving = shocks[1:] + 0.8 * shocks[:-1]
    found = {r.series: r for r in serial.series_diagnostics(indexed(spark, noise=noise, moving=moving, flat=np.ones(50), short=[1.0, 2.0]), 10).collect()}
    assert found["noise"].status == "computed" and not found["noise"].any_acf_significant and not found["noise"].ljung_box.rejected
    acf = [r.acf for r in found["moving"].lag_rows]
    assert acf[0] > 0.45 and max(map(abs, acf[1:])) < 0.06 and found["moving"].strongest_lag == 1
    assert found["flat"].constant_series and found["flat"].status == "insufficient_or_constant_series" and found["flat"].lag_rows[0].acf is None
    assert found["short"].evaluated_max_lag == 0
    c = moving - moving.mean()
    assert acf[2] == pytest.approx(c[3:] @ c[:-3] / (c @ c))
    with pytest.raises(ValueError):
        serial.reject_nonfinite(indexed(spark, a=[0.1, float("nan"), 0.2]))


def test_volatility_memory(spark):
    g, h = np.random.default_rng(2718), 0.0
    x = []
    for _ in range(6000):
        h = 0.97 * h + 0.2 * g.normal()
        x.append(0.01 * math.exp(h / 2) * g.normal())
    flat, flags = serial.dependence_diagnostics(indexed(spark, a=x))
    row = flags.first()
    assert row.volatility_memory and row.residual_memory is None and flat.count() == 3


def test_gaps_are_renumbered(spark):
    df = indexed(spark, a=[1.0, float("nan"), 2.0, float("inf"), 3.0])
    assert [(r.idx, r.value) for r in inference.renumbered(df).orderBy("idx").collect()] == [(0, 1.0), (1, 2.0), (2, 3.0)]


def test_validation_job(spark, tmp_path):
    x = np.random.default_rng(73).normal(0, 0.007, 120)
    x[1:] += 0.35 * x[:-1]
    raw = daily(spark, x).select("series", F.col("date").cast("string").alias("date"), F.col("net_return").cast("string").alias("net_return"))
    found = sequential_validation(raw, [10, 20, 40], 3, 200)
    row = found["result"].first()
    assert row.status.startswith("diagnostic_only") and len(row.window_summary) == 3 and row.inference.block_bootstrap.block_length >= 3
    write_validation(found, str(tmp_path / "out"))
    assert (tmp_path / "out/report").exists() and spark.read.json(str(tmp_path / "out/result")).count() == 1
    assert "horizon 10" in "\n".join(r.value for r in spark.read.text(str(tmp_path / "out/report")).collect())


def test_nonfinite_values(spark):
    """Inference closes gaps up; diagnostics refuse them, as lags would change."""
    x = np.random.default_rng(3).normal(0.001, 0.01, 60)
    gaps = np.insert(x, [7, 7, 30, 60], [np.nan, np.inf, np.nan, -np.inf])
    whole, holed = indexed(spark, a=x), indexed(spark, a=gaps)
    a, b = (inference.newey_west(df, 5).first() for df in (whole, holed))
    assert b.nominal_observations == 60 and (a.mean, a.hac_t_stat) == pytest.approx((b.mean, b.hac_t_stat)) and a.lag_autocorrelations == pytest.approx(b.lag_autocorrelations)
    blocks = spark.createDataFrame([("a", 5)], "series string, block_length long")
    a, b = (inference.bootstrap_mean(df, blocks, 100).first() for df in (whole, holed))
    assert b.available and a.confidence_interval_low == pytest.approx(b.confidence_interval_low)
    for run in (serial.series_diagnostics, serial.dependence_diagnostics):
        with pytest.raises(ValueError, match="non-finite"):
            run(holed)
    flat = inference.newey_west(indexed(spark, a=[0.001, np.nan] * 20)).first()
    assert flat.nominal_observations == 20 and flat.hac_t_stat is None
