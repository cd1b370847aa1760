import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.functions import numeric
from tidegauge.functions.clocks import strict_clock, strict_date
from tidegauge.functions.symbols import assert_symbol6, is_symbol6, normalize_symbol


def test_chi_square_closed_forms():
    assert numeric.chi_square_survival(4, 2) == pytest.approx(math.exp(-2), rel=1e-12)
    assert numeric.chi_square_survival(4, 4) == pytest.approx(3 * math.exp(-2), rel=1e-12)
    assert numeric.chi_square_survival(1, 1) == pytest.approx(math.erfc(math.sqrt(0.5)), rel=1e-12)
    for bad in ((-1, 2), (1, 0), (math.inf, 2)):
        with pytest.raises(ValueError):
            numeric.chi_square_survival(*bad)


def test_block_means_by_definition():
    x = np.random.default_rng(3).normal(size=53)
    g, means = np.random.default_rng(11), []
    for _ in range(40):
        starts = g.integers(0, 53, size=8)
        means.append(x[(starts[:, None] + np.arange(7)).reshape(-1)[:53] % 53].mean())
    assert np.allclose(numeric.block_means(x, 7, 40, 11), means)


def test_partial_autocorrelation_of_ar1():
    g = np.random.default_rng(1729)
    x = np.zeros(4000)
    for t, e in enumerate(g.normal(size=4000)):
        x[t] = 0.72 * x[t - 1] + e
    p = numeric.partial_autocorrelations(x, 12)
    assert p[0] > 0.65 and max(map(abs, p[1:])) < 0.08
    assert numeric.partial_autocorrelations(np.ones(20), 3) == [None] * 3


def test_symbols(spark):
    cases = {None: "", " 1 ": "000001", "1234567": "234567", "-5": "-00005", "+5": "000005", "12.0": "000012", "12.5": "000125", "sz000002": "000002", "bad": "", "NaN": "", "--7": "", "": "", "none": "", "007": "000007", "-0": "000000"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "raw string, want string")
    assert df.where(normalize_symbol(df, "raw") != F.col("want")).count() == 0
    numbers = spark.createDataFrame([(7, 7.0, True), (1234567, 12.5, False), (None, float("nan"), None)], "i long, d double, b boolean")
    got = numbers.select(normalize_symbol(numbers, "i"), normalize_symbol(numbers, "d"), normalize_symbol(numbers, "b")).collect()
    assert [tuple(r) for r in got] == [("000007", "000007", ""), ("1234567", "000125", ""), ("", "", "")]
    assert [r[0] for r in spark.createDataFrame([("000001",), ("1",), (None,)], "s string").select(is_symbol6("s")).collect()] == [True, False, False]
    with pytest.raises(ValueError):
        assert_symbol6(df, "raw")


def test_clocks(spark):
    df = spark.createDataFrame([("2026-07-02", "2026-07-02T10:00:00+08:00"), ("2026-7-2", "2026-07-02T10:00:00"), ("2026-02-30", "2026-07-02T02:00:00Z"), (None, "x")], "d string, c string")
    rows = df.select(strict_date("d").cast("string").alias("d"), strict_clock("c").cast("string").alias("c")).collect()
    assert [r.d for r in rows] == ["2026-07-02", None, None, None]
    assert [r.c for r in rows] == ["2026-07-02 02:00:00", None, "2026-07-02 02:00:00", None]
