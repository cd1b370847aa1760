import math

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import numeric, special


def test_erfc(spark):
    xs = [0.0, -0.0, 1e-300, 1e-9, 0.3, 0.5, 1.0, 1.7, 2.4999999, 2.5, 2.5000001, 3.0, 4.5, 6.0, 10.0, 20.0, 26.5, 29.0, 31.0, 1e300, math.inf, *[k / 17 for k in range(200)]]
    xs += [-x for x in xs]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", special.erfc(F.col("x")).alias("y")).collect()
    for r in got:
        assert abs(r.y - math.erfc(r.x)) <= 1e-12 * math.erfc(r.x) + 1e-300, r
    odd = spark.createDataFrame([(None,), (math.nan,)], "x double").select(special.erfc(F.col("x")).alias("y")).collect()
    assert odd[0].y is None and math.isnan(odd[1].y)


def test_chi_square(spark):
    rows = [(s, d) for s in (0.0, 1e-9, 0.1, 1.0, 4.0, 20.0, 55.5, 300.0, 1500.0, 4000.0) for d in (1, 2, 3, 4, 5, 19, 20, 61, 1400)]
    got = spark.createDataFrame(rows, "s double, d long").select("s", "d", special.chi_square_survival(F.col("s"), F.col("d")).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(numeric.chi_square_survival(r.s, r.d), rel=1e-11, abs=1e-300), r
    closed = {(4.0, 2): math.exp(-2), (4.0, 4): 3 * math.exp(-2), (1.0, 1): math.erfc(math.sqrt(0.5))}
    assert all(r.p == pytest.approx(closed[r.s, r.d], rel=1e-12) for r in got if (r.s, r.d) in closed)
    none = spark.createDataFrame([(1.0, 0), (1.0, None), (None, 3)], "s double, d long").select(special.chi_square_survival(F.col("s"), F.col("d")).alias("p")).collect()
    assert [r.p for r in none] == [None] * 3
    for bad in (-1.0, math.nan, math.inf):
        with pytest.raises(Exception, match="chi-square"):
            spark.createDataFrame([(bad, 2)], "s double, d long").select(special.chi_square_survival(F.col("s"), F.col("d"))).collect()
