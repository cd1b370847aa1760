"""Serial dependence of series (series, idx, value): correlations, tests, diagnostics."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidegauge.functions.numeric import TINY, UNIT, factor, last_coefficients, merged
from tidegauge.functions.special import chi_square_survival, erfc
from tidegauge.operators.inference import BUCKET, lag_products, moments
from tidegauge.operators.multiplicity import step_up
from tidegauge.operators.returns import nonfinite_series
from tidegauge.operators.windows import with_halo
from tidegauge.sources.tables import stash

BAND = 1.959963984540054


def lag_limit(n: Column, most: int) -> Column:
    if most < 1:
        raise ValueError("the largest lag must be positive")
    return F.when(n < 4, 0).otherwise(F.least(F.lit(most), F.floor(n / 4), n - 2)).cast("long")


def reject_nonfinite(values: DataFrame) -> DataFrame:
    """An error if a series has a gap; closing it up would change every lag."""
    if bad := nonfinite_series(values).limit(5).collect():
        raise ValueError(f"non-finite values in {[r.series for r in bad]}")
    return values


def _known(values: DataFrame, most: int) -> DataFrame:
    m = moments(values).withColumn("lags", lag_limit(F.col("n"), most))
    return m.withColumn("varies", F.col("centered_energy") > UNIT * F.greatest("energy", F.lit(TINY)))


def autocorrelations(values: DataFrame, max_lag: int = 20, known: DataFrame | None = None) -> DataFrame:
    """(series, lag, acf); null where the variation cannot be told from rounding.  A series
    with a value that is not finite is an error; ``known``: the caller has looked."""
    known = known or stash(_known(reject_nonfinite(values), max_lag), "moments")
    products = lag_products(values, known, max_lag).join(known.select("series", "centered_energy", "varies"), "series")
    return products.select("series", "lag", F.when(F.col("varies"), F.col("product") / F.col("centered_energy")).alias("acf"))


#: Factors that one task merges.
MERGED = 256


def partial_autocorrelation_rows(values: DataFrame, max_lag: int = 20, known: DataFrame | None = None) -> DataFrame:
    """(series, lag, pacf): the last coefficient of the regression on 1 to ``lag`` lags.

    Buckets of a series, with the rows before them, give the triangular factors of their
    regression rows, which are merged ``MERGED`` at a time up a tree.  A factor is no
    larger than the lags squared, and has the singular values of all its rows, so the
    rank is judged as in a regression on the whole series; sums of products would have
    them squared and lose it.  Errors as in ``autocorrelations``.
    """
    known = known or stash(_known(reject_nonfinite(values), max_lag), "moments")
    top = known.agg(F.max("lags").alias("lags"), F.max("n").alias("n")).first()
    most = int(top.lags or 0)
    size = max(BUCKET, 4 * most)
    buckets = -(-int(top.n or 0) // size)
    kind, id_type = values.schema["series"].dataType.simpleString(), to_arrow_type(values.schema["series"].dataType)
    limits = known.where("lags > 0").select("series", "mean", "lags", "varies", "n")
    centered = values.join(limits.where("varies"), "series").select("series", "idx", (F.col("value") - F.col("mean")).alias("c"), "lags", "n")
    shape = f"series {kind}, bucket long, lags long, n long, head binary, factor binary"

    def factors(group: pa.Table) -> pa.Table:
        group = group.sort_by("idx")
        c, bucket, lags, n = group.column("c").to_numpy(), group.column("bucket")[0].as_py(), group.column("lags")[0].as_py(), group.column("n")[0].as_py()
        start = int(np.searchsorted(group.column("idx").to_numpy(), bucket * size))
        head = c[:lags] if bucket == 0 else c[:0]
        return _row(group.column("series")[0], bucket, lags, n, head, factor(c, lags, start))

    def merge(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        lags = rows[0]["lags"]
        head = max((np.frombuffer(r["head"]) for r in rows), key=len)
        return _row(group.column("series")[0], rows[0]["bucket"] // MERGED, lags, rows[0]["n"], head, merged([np.frombuffer(r["factor"]).reshape(-1, lags + 2) for r in rows]))

    def _row(series, bucket, lags, n, head, found) -> pa.Table:
        return pa.table({"series": pa.array([series.as_py()], id_type), "bucket": [bucket], "lags": [lags], "n": [n], "head": pa.array([head.tobytes()], pa.binary()), "factor": pa.array([np.ascontiguousarray(found).tobytes()], pa.binary())})

    tree = with_halo(centered, size, most).select("series", "bucket", "idx", "c", "lags", "n").groupBy("series", "bucket").applyInArrow(factors, shape)
    while buckets > 1:
        tree, buckets = tree.groupBy("series", F.floor(F.col("bucket") / MERGED).alias("group")).applyInArrow(merge, shape), -(-buckets // MERGED)

    def solve(batches):
        for b in batches:
            for row in b.to_pylist():
                got = last_coefficients(np.frombuffer(row["factor"]).reshape(-1, row["lags"] + 2), np.frombuffer(row["head"]), row["n"])
                yield pa.RecordBatch.from_arrays([pa.array([row["series"]] * len(got), id_type), pa.array(np.arange(1, len(got) + 1)), pa.array(got, pa.float64())], names=["series", "lag", "pacf"])

    found = tree.mapInArrow(solve, f"series {kind}, lag long, pacf double")
    flat = limits.where("not varies").select("series", F.explode(F.sequence(F.lit(1).cast("long"), "lags")).alias("lag"), F.lit(None).cast("double").alias("pacf"))
    return found.unionByName(flat)


def ljung_box(acf: DataFrame, sizes: DataFrame, model_degrees: int = 0) -> DataFrame:
    """Q statistic, degrees and p-value of each series; ``sizes``: (series, n, lags)."""
    q = acf.join(sizes, "series").groupBy("series").agg((F.first("n") * (F.first("n") + 2) * F.sum(F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag")))).alias("statistic"), F.first("lags").alias("lags"))
    degrees = F.col("lags") - model_degrees
    return q.select("series", "statistic", F.when(degrees > 0, degrees).alias("degrees_of_freedom")).withColumn("p_value", chi_square_survival(F.col("statistic"), F.col("degrees_of_freedom")))


def series_diagnostics(values: DataFrame, max_lag: int = 20, model_degrees: int = 0, alpha: float = 0.05) -> DataFrame:
    """One record for each series, with its lags in an array; an error if a value is not finite."""
    if not 0 < alpha < 1 or model_degrees < 0:
        raise ValueError("alpha must be between zero and one, model degrees at least 0")
    values = reject_nonfinite(stash(values, "diagnosed"))
    zeros = values.groupBy("series").agg(F.avg((F.col("value") == 0).cast("double")).alias("zero_fraction"))
    known = stash(_known(values, max_lag).join(zeros, "series"), "moments")
    acf = stash(autocorrelations(values, max_lag, known), "autocorrelations")
    lags = acf.join(partial_autocorrelation_rows(values, max_lag, known), ["series", "lag"], "left").join(known.select("series", "n"), "series")
    kinds = F.array(F.struct(F.lit("acf").alias("kind"), F.col("acf").alias("r")), F.struct(F.lit("pacf").alias("kind"), F.col("pacf").alias("r")))
    tests = lags.select("series", "lag", "n", F.inline(kinds)).withColumn("p_value", erfc(F.abs("r") * F.sqrt("n") / math.sqrt(2)))
    tests = tests.withColumn("p_value", F.when(F.col("r").isNotNull(), F.col("p_value")))
    tests = step_up(tests, ("series", "kind")).withColumn("exceeds", F.abs("r") > BAND / F.sqrt("n"))
    one = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    wide = tests.groupBy("series", "lag").agg(*[one(k, c).alias(n) for k in ("acf", "pacf") for c, n in (("r", k), ("p_value", f"{k}_p_value"), ("q_value", f"{k}_q_value"), ("exceeds", f"{k}_exceeds_band"))])
    record = F.struct("lag", *[f"{k}{x}" for k in ("acf", "pacf") for x in ("", "_p_value", "_q_value", "_exceeds_band")])
    rolled = wide.groupBy("series").agg(
        F.sort_array(F.collect_list(record)).alias("lag_rows"), F.max_by(F.struct("lag", "acf"), F.when(F.col("acf").isNotNull(), F.struct(F.abs("acf"), -F.col("lag")))).alias("strongest"), F.count("acf").alias("usable"),
        F.coalesce(F.bool_or(F.col("acf_q_value") <= alpha), F.lit(False)).alias("any_acf_significant"), F.coalesce(F.bool_or(F.col("pacf_q_value") <= alpha), F.lit(False)).alias("any_pacf_significant"),
    )
    box = ljung_box(acf, known.select("series", "n", "lags"), model_degrees).select("series", F.struct("statistic", "degrees_of_freedom", "p_value", F.coalesce(F.col("p_value") <= alpha, F.lit(False)).alias("rejected")).alias("ljung_box"))
    joined = known.join(rolled, "series", "left").join(box, "series", "left")
    usable = F.coalesce("usable", F.lit(0)) > 0
    return joined.select(
        "series", F.when(usable, "computed").otherwise("insufficient_or_constant_series").alias("status"), F.col("n").alias("nominal_observations"), F.col("lags").alias("evaluated_max_lag"), (BAND / F.sqrt("n")).alias("band"),
        ((F.col("n") > 0) & ~F.col("varies")).alias("constant_series"), "zero_fraction", F.col("strongest.lag").alias("strongest_lag"), F.col("strongest.acf").alias("strongest_acf"),
        F.coalesce("any_acf_significant", F.lit(False)).alias("any_acf_significant"), F.coalesce("any_pacf_significant", F.lit(False)).alias("any_pacf_significant"), "ljung_box", F.col("lag_rows"),
    )


def dependence_diagnostics(values: DataFrame, max_lag: int = 20, residuals: DataFrame | None = None, residual_degrees: int = 0, alpha: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Diagnostics of each series and of its absolute and squared values (and residuals),
    as (series, transform, ...), and flags of memory of each series."""
    forms = F.array(*[F.struct(F.lit(n).alias("transform"), v.alias("value")) for n, v in (("returns", F.col("value")), ("absolute_returns", F.abs("value")), ("squared_returns", F.col("value") * F.col("value")))])
    named = F.concat_ws("|", "transform", F.col("name").cast("string")).alias("series")
    stacked = values.select(F.col("series").alias("name"), "idx", F.inline(forms)).select(named, "idx", "value")
    found = series_diagnostics(stacked, max_lag, 0, alpha)
    if residuals is not None:
        rest = residuals.select(F.col("series").alias("name"), F.lit("model_residuals").alias("transform"), "idx", "value").select(named, "idx", "value")
        found = found.unionByName(series_diagnostics(rest, max_lag, residual_degrees, alpha))
    flat = found.select(F.expr("substring(series, instr(series, '|') + 1)").alias("series"), F.substring_index("series", "|", 1).alias("transform"), *[c for c in found.columns if c != "series"])
    memory = F.col("any_acf_significant") | F.coalesce("ljung_box.rejected", F.lit(False))
    has = lambda *names: F.bool_or(F.when(F.col("transform").isin(*names), memory))
    flags = flat.groupBy("series").agg(F.coalesce(has("returns"), F.lit(False)).alias("linear_return_memory"), F.coalesce(has("absolute_returns", "squared_returns"), F.lit(False)).alias("volatility_memory"), has("model_residuals").alias("residual_memory"))
    return flat, flags
