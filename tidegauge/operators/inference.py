"""Inference on means of dependent series (series, idx, value)."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidegauge.functions.numeric import UNIT, block_sums, counted_draws
from tidegauge.functions.special import erfc
from tidegauge.operators.returns import finite
from tidegauge.operators.windows import with_halo
from tidegauge.sources.tables import stash

#: Places of a series whose lag products one task adds up.
BUCKET = 1 << 16
LEAST_BLOCKS, LEAST_DISTINCT = 4.0, 20
#: Numbers of a series that are packed into a row, and running sums that a task of the bootstrap holds.
PIECE, HELD = 1 << 16, 1 << 23
#: Draws that a task makes at least where there are so many, tasks at most among which the resamples of a bucket are dealt,
#: raw numbers of the stream that are counted together, and resamples in a row of what a task knows.
DRAWS, RANGES, SLICE, ROW = 1 << 28, 4, 1 << 24, 1 << 12


def renumbered(values: DataFrame) -> DataFrame:
    """series, idx and value of what is finite, numbered anew in the old order: lag k
    is k surviving rows.  Numbers come from counts of stretches first."""
    kept = values.where(finite("value")).withColumn("stretch", F.floor(F.col("idx") / BUCKET))
    earlier = Window.partitionBy("series").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = kept.groupBy("series", "stretch").count().select("series", "stretch", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("series", "stretch").orderBy("idx"))
    return kept.join(before, ["series", "stretch"]).select("series", (F.col("before") + place - 1).alias("idx"), "value")


def hac_lag(n: Column, overlap_horizon: int = 1, minimum_lag: int = 0) -> Column:
    rule = F.floor(4 * F.pow(n / 100.0, F.lit(2 / 9))).cast("long")
    return F.when(n <= 1, 0).otherwise(F.least(n - 1, F.greatest(F.lit(overlap_horizon - 1), F.lit(minimum_lag), rule))).cast("long")


def moments(values: DataFrame) -> DataFrame:
    """n, mean, energy about zero and about the mean of each series."""
    m = values.groupBy("series").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.sum(F.col("value") * F.col("value")), F.lit(0.0)).alias("energy"))
    about = values.join(m, "series").groupBy("series").agg(F.sum((F.col("value") - F.col("mean")) * (F.col("value") - F.col("mean"))).alias("centered_energy"))
    return m.join(about, "series")


def lag_products(values: DataFrame, limits: DataFrame, most: int | None = None) -> DataFrame:
    """(series, lag, product): sum over i of c[i] c[i - lag] for lags 1 to the series'
    own ``lags``, c being the values less their mean.

    ``limits``: (series, mean, lags).  Rows are dealt to buckets that carry as many rows
    before them as the longest lag, and the buckets' sums are added.
    """
    if most is None:
        most = int(limits.agg(F.max("lags")).first()[0] or 0)
    size = max(BUCKET, 4 * most)
    centered = values.join(limits.select("series", "mean", "lags"), "series").select("series", "idx", (F.col("value") - F.col("mean")).alias("c"), "lags")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        c, own, lags = rows["c"].to_numpy(), (rows["idx"] // size == key[1]).to_numpy(), int(rows["lags"].iloc[0])
        start = len(c) - int(own.sum())
        sums = [float(c[max(start, k) :] @ c[max(start, k) - k : len(c) - k]) if len(c) > k else 0.0 for k in range(1, lags + 1)]
        return pd.DataFrame({"series": rows["series"].iloc[0], "lag": np.arange(1, lags + 1), "part": sums})

    kind = values.schema["series"].dataType.simpleString()
    parts = with_halo(centered, size, most).select("series", "bucket", "idx", "c", "lags").groupBy("series", "bucket").applyInPandas(run, f"series {kind}, lag long, part double")
    return parts.groupBy("series", "lag").agg(F.sum("part").alias("product"))


def newey_west(values: DataFrame, overlap_horizon: int = 1, minimum_lag: int = 0, dense: bool = False) -> DataFrame:
    """Mean, plain and long-run standard errors, t statistics, p-values and effective
    observations of each series.  Without a basis a figure is null.  Values that are not
    finite are left out, and a series of such values alone has no row; with ``dense`` the
    caller has done so."""
    values = values if dense else stash(renumbered(values), "renumbered")
    known = stash(moments(values).withColumn("lags", hac_lag(F.col("n"), overlap_horizon, minimum_lag)), "moments")
    gamma = F.col("centered_energy") / F.col("n")
    products = lag_products(values, known).join(known.select("series", "n", "lags", "centered_energy"), "series")
    weighed = products.groupBy("series").agg(
        F.sum(2 * (1 - F.col("lag") / (F.col("lags") + 1)) * F.col("product") / F.col("n")).alias("weighed"),
        F.transform(F.sort_array(F.collect_list(F.struct("lag", F.when(gamma > 1e-15, F.col("product") / F.col("centered_energy")).alias("r")))), lambda x: x["r"]).alias("lag_autocorrelations"),
    )
    df = known.join(weighed, "series", "left")
    many = F.col("n") > 1
    df = df.withColumns({"variance": F.when(many, F.col("centered_energy") / (F.col("n") - 1)), "hac_long_run_variance": F.when(many, F.greatest(F.lit(0.0), gamma + F.coalesce("weighed", F.lit(0.0))))})
    df = df.withColumns({"iid_standard_error": F.sqrt(F.col("variance") / F.col("n")), "hac_standard_error": F.sqrt(F.col("hac_long_run_variance") / F.col("n"))})
    df = df.withColumns({"iid_t_stat": F.when(F.col("iid_standard_error") > 1e-15, F.col("mean") / F.col("iid_standard_error")), "hac_t_stat": F.when(F.col("hac_standard_error") > 1e-15, F.col("mean") / F.col("hac_standard_error"))})
    effective = F.when((F.col("hac_long_run_variance") > 1e-15) & (F.col("variance") > 0), F.least(F.col("n").cast("double"), F.greatest(F.lit(1.0), F.col("n") * F.col("variance") / F.col("hac_long_run_variance"))))
    root = F.col("hac_t_stat") / math.sqrt(2)
    return df.select(
        "series", F.col("n").alias("nominal_observations"), effective.alias("effective_observations"), "mean", "iid_standard_error", "iid_t_stat", F.col("lags").alias("hac_lag"), "hac_long_run_variance", "hac_standard_error", "hac_t_stat",
        erfc(F.abs(root)).alias("hac_two_sided_p_value"), (0.5 * erfc(root)).alias("hac_positive_one_sided_p_value"), (0.5 * erfc(-root)).alias("hac_negative_one_sided_p_value"),
        F.coalesce("lag_autocorrelations", F.array().cast("array<double>")).alias("lag_autocorrelations"),
    )


def hac_ratios(inference: DataFrame, periods: int = 252) -> DataFrame:
    """t statistic and annualised ratio of the mean to the long-run deviation (NaN where
    there is none)."""
    ratio = F.when(F.col("hac_long_run_variance") > 1e-15, F.col("mean") / F.sqrt("hac_long_run_variance") * math.sqrt(periods)).otherwise(float("nan"))
    return inference.select("series", "hac_t_stat", ratio.alias("hac_annualized_ratio"))


def block_design(n: Column, block: Column, least: float = LEAST_BLOCKS) -> Column:
    """Effective blocks of a block bootstrap and the reasons against it."""
    n, block = F.greatest(n, F.lit(0)), F.greatest(block, F.lit(1))
    blocks = n / block
    reasons = F.array_compact(F.array(F.when(n < 2, "fewer_than_two_observations"), F.when((block >= n) & (n > 0), "block_length_not_smaller_than_sample"), F.when(blocks < least, "too_few_effective_blocks")))
    return F.struct(blocks.alias("effective_blocks"), reasons.alias("reasons"))


def audit_distribution(statistics: DataFrame, least: int = LEAST_DISTINCT) -> DataFrame:
    """Whether resampled statistics (series, value) differ enough: span, how many are
    distinct, and the reasons against them."""
    good = statistics.where(finite("value"))
    width = good.groupBy("series").agg(F.count("*").alias("finite_statistics"), (UNIT * 64 * F.greatest(F.lit(1.0), F.max(F.abs("value")))).alias("tolerance"), (F.max("value") - F.min("value")).alias("span"))
    distinct = good.join(width, "series").select("series", F.rint(F.col("value") / F.col("tolerance")).alias("step")).distinct().groupBy("series").agg(F.count("*").alias("unique_statistics"))
    found = statistics.select("series").distinct().join(width, "series", "left").join(distinct, "series", "left")
    none = F.coalesce("finite_statistics", F.lit(0)) == 0
    reasons = F.array_compact(F.array(F.when(none, "no_finite_bootstrap_statistics"), F.when(F.col("span") <= F.col("tolerance"), "numerically_degenerate_bootstrap_distribution"), F.when(~none & (F.col("unique_statistics") < least), "too_few_unique_bootstrap_statistics")))
    return found.select("series", F.coalesce("finite_statistics", F.lit(0)).alias("finite_statistics"), F.coalesce("unique_statistics", F.lit(0)).alias("unique_statistics"), F.col("span").alias("numeric_span"), reasons.alias("reasons"))


def packed(values: DataFrame) -> DataFrame:
    """(series, piece, count, sum, packed) of (series, idx, value): the values of each
    ``PIECE`` numbers of a series as bytes, in order."""
    kind, size = values.schema["series"].dataType, min(PIECE, HELD)
    id_type = to_arrow_type(kind)

    def runs(batches):
        for b in batches:
            if not b.num_rows:
                continue
            names = b.column("series").dictionary_encode()
            of, piece, x = names.indices.to_numpy(), b.column("idx").to_numpy() // size, b.column("value").to_numpy()
            cuts = np.flatnonzero((np.diff(of) != 0) | (np.diff(piece) != 0)) + 1
            for i, j in zip([0, *cuts], [*cuts, len(x)], strict=True):
                yield (names.dictionary[of[i]].as_py(), int(piece[i])), x[i:j]

    def batch(rows):
        names, pieces, xs = zip(*rows, strict=True)
        arrays = [pa.array(names, id_type), pa.array(pieces, pa.int64()), pa.array([len(x) for x in xs], pa.int64()), pa.array([float(x.sum()) for x in xs]), pa.array([x.tobytes() for x in xs], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["series", "piece", "count", "sum", "packed"])

    def run(batches):
        rows, held = [], 0
        for key, parts in itertools.groupby(runs(batches), key=lambda r: r[0]):
            rows.append((*key, np.concatenate([x for _, x in parts])))
            held += len(rows[-1][-1])
            if held >= size:
                yield batch(rows)
                rows, held = [], 0
        if rows:
            yield batch(rows)

    n = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    light = values.where("series is not null and idx is not null").select("series", F.col("idx").cast("long").alias("idx"), F.col("value").cast("double").alias("value"))
    dealt = light.repartition(n, "series", F.floor(F.col("idx") / size)).sortWithinPartitions("series", "idx")
    return dealt.mapInArrow(run, f"series {kind.simpleString()}, piece long, count long, sum double, packed binary")


def _starts(ranges: DataFrame, seed: int) -> DataFrame:
    """(n, draw, slice, skip) for ranges (n, draw, draws): the last slice of the stream whose draws below n
    begin at ``draw`` or before, and how many lie between."""

    def run(batches):
        for b in batches:
            n, at = b.column("n").to_pylist(), b.column("slice").to_pylist()
            counts = [counted_draws(seed, m, k * SLICE, SLICE) for m, k in zip(n, at, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("n"), b.column("slice"), pa.array(counts, pa.int64())], names=["n", "slice", "count"])

    later = ranges.where("draw > 0").select("n", "draw").distinct()
    slices = later.groupBy("n").agg(F.max("draw").alias("draw")).select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("draw") / SLICE))).alias("slice"))
    # With a number of partitions, small rows that cost much are not put together.
    dealt = slices.repartition(int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "n", "slice")
    earlier = Window.partitionBy("n").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counted = stash(dealt.mapInArrow(run, "n long, slice long, count long"), "slices").select("n", "slice", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    found = later.join(counted, "n").where("before <= draw").groupBy("n", "draw").agg(F.max(F.struct("slice", "before")).alias("at"))
    return found.select("n", "draw", "at.slice", (F.col("draw") - F.col("at.before")).alias("skip"))


def block_mean_rows(values: DataFrame, sizes: DataFrame, resamples: int, seed: int) -> DataFrame:
    """(series, resample, mean) of circular moving-block resamples.

    ``values``: (series, idx, value) without gaps; ``sizes``: (series, n, block_length).
    """
    return _resampled(stash(packed(values), "pieces"), sizes, resamples, seed).select("series", "resample", "mean")


def _resampled(pieces: DataFrame, sizes: DataFrame, resamples: int, seed: int) -> DataFrame:
    """(series, resample, mean, own_mean) of circular moving-block resamples of ``packed`` values.

    A block's sum is the difference of two running sums, so a series is cut into buckets of
    ``HELD`` running sums, and resamples into up to ``RANGES`` ranges of ``DRAWS`` draws or more.
    A task has one bucket and one range: it goes through its own slice of the seed's stream and
    adds what its bucket knows of each resample.  A whole series is never in a task, and
    its values are dealt out ``RANGES`` times at most, whatever its length; each bucket costs
    all draws, some nanoseconds each.
    """
    held, piece, row_of = HELD, min(PIECE, HELD), ROW
    blocks = F.ceil(F.col("n") / F.col("block_length"))
    each = F.least(F.lit(resamples), F.greatest(F.lit(-(-resamples // RANGES)), F.floor(F.lit(DRAWS) / blocks))).cast("long")
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(resamples - 1).cast("long"), F.col("each")))
    ranges = sizes.select("series", "n", "block_length", each.alias("each")).select("*", first.alias("first"))
    ranges = stash(ranges.select("series", "n", "block_length", "first", F.least(F.col("each"), resamples - F.col("first")).alias("m"), (F.col("first") * blocks).alias("draw")), "ranges")
    ranges = ranges.join(_starts(ranges, seed), ["n", "draw"], "left").select("series", "n", "block_length", "first", "m", F.coalesce("slice", F.lit(0)).alias("slice"), F.coalesce("skip", F.lit(0)).alias("skip"))

    mine = Window.partitionBy("series")
    earlier = mine.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    place, before = F.coalesce(F.sum("count").over(earlier), F.lit(0)), F.coalesce(F.sum("sum").over(earlier), F.lit(0.0))
    levels = pieces.select("series", "piece", place.alias("place"), before.alias("before"), F.sum("sum").over(mine).alias("total")).withColumn("bucket", F.floor(F.col("place") / held))
    # Written, so their size is known to a join that need not deal out the pieces.
    shares = stash(levels.join(ranges, "series"), "shares")
    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = pieces.select("series", "piece", "packed").join(shares, ["series", "piece"]).repartition(n, "series", "bucket", "first").sortWithinPartitions("series", "bucket", "first", "piece")
    kind = pieces.schema["series"].dataType
    id_type = to_arrow_type(kind)

    def rows_of(batches):
        for b in batches:
            xs = b.column("packed")
            for i, row in enumerate(b.drop_columns(["packed"]).to_pylist()):
                yield row, np.frombuffer(xs[i].as_buffer())

    def run(batches):
        for (series, bucket, first), rows in itertools.groupby(rows_of(batches), key=lambda r: (r[0]["series"], r[0]["bucket"], r[0]["first"])):
            level, at = None, 0
            for row, x in rows:
                if level is None:
                    begin, level = row, np.empty(min(row["n"] - row["place"], held + piece) + 1)
                    level[0] = row["before"]
                level[at + 1 : at + len(x) + 1] = np.cumsum(x) + level[at]
                at += len(x)
            level[at] = 0
            sums = block_sums(level[: at + 1], begin["place"], begin["total"], begin["n"], begin["block_length"], begin["m"], seed, begin["slice"] * SLICE, begin["skip"])
            del level
            parts = [sums[i : i + row_of] for i in range(0, len(sums), row_of)]
            columns = [pa.array([series] * len(parts), id_type), pa.array(first + row_of * np.arange(len(parts))), pa.array([bucket] * len(parts), pa.int64()), pa.array([begin["n"]] * len(parts), pa.int64()), pa.array([begin["total"]] * len(parts)), pa.array(parts, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["series", "first", "bucket", "n", "total", "part"])

    parts = tasks.mapInArrow(run, f"series {kind.simpleString()}, first long, bucket long, n long, total double, part array<double>")
    added = F.reduce(F.array_sort(F.collect_list(F.struct("bucket", "part"))), F.array().cast("array<double>"), lambda a, b: F.when(F.size(a) == 0, b["part"]).otherwise(F.zip_with(a, b["part"], lambda x, y: x + y)))
    known = parts.groupBy("series", "first").agg(F.first("n").alias("n"), F.first("total").alias("total"), added.alias("sums"))
    rows = known.select("series", "first", "n", (F.col("total") / F.col("n")).alias("own_mean"), F.posexplode("sums").alias("at", "sum"))
    return rows.select("series", (F.col("first") + F.col("at")).alias("resample"), (F.col("sum") / F.col("n")).alias("mean"), "own_mean")


def bootstrap_mean(values: DataFrame, blocks: DataFrame, resamples: int = 1000, seed: int = 1729, confidence: float = 0.95, dense: bool = False) -> DataFrame:
    """Circular moving-block bootstrap of each series' mean.

    ``blocks``: (series, block_length).  Every series draws the same stream of the
    seed.  Values that are not finite are left out, and the others close up; with ``dense`` the caller has done so.
    """
    if not 0 < confidence < 1:
        raise ValueError("confidence must be between zero and one")
    pieces = stash(packed(values if dense else values.where(finite("value"))), "pieces")
    counted = pieces.groupBy("series").agg(F.sum("count").alias("n"), (F.sum("sum") / F.sum("count")).alias("own_mean"))
    sized = counted.join(blocks, "series", "right").withColumn("n", F.coalesce("n", F.lit(0)))
    design = sized.withColumn("design", block_design(F.col("n"), F.col("block_length"))).withColumn("reasons", F.concat("design.reasons", F.array(*([F.lit("nonpositive_resample_count")] if resamples <= 0 else [])).cast("array<string>")))
    design = stash(design, "block-designs")
    fit = design.where("size(reasons) = 0").select("series", "n", F.col("block_length").cast("long").alias("block_length"))
    rows = stash(_resampled(pieces, fit, max(resamples, 1), seed), "resamples")
    null, tail = F.col("mean") - F.col("own_mean"), (1 - confidence) / 2
    drawn_ = rows.groupBy("series").agg(
        F.percentile("mean", F.array(F.lit(tail), F.lit(1 - tail))).alias("ends"), *[((1 + F.count_if(hit)) / (resamples + 1)).alias(name) for name, hit in (("positive", null >= F.col("own_mean")), ("negative", null <= F.col("own_mean")))]
    )
    audit = audit_distribution(rows.select("series", null.alias("value"))).select("series", F.col("reasons").alias("own_reasons"))
    joined = design.join(drawn_.join(audit, "series"), "series", "left")
    none = F.array().cast("array<string>")
    good = F.size(F.coalesce("own_reasons", F.array(F.lit("none drawn")))) == 0
    shown = lambda c: F.when(good, c)
    return joined.select(
        "series", F.col("n").alias("nominal_observations"), "block_length", "design.effective_blocks", shown(F.col("own_mean")).alias("mean"), shown(F.col("ends")[0]).alias("confidence_interval_low"), shown(F.col("ends")[1]).alias("confidence_interval_high"),
        shown(F.col("positive")).alias("positive_one_sided_p_value"), shown(F.col("negative")).alias("negative_one_sided_p_value"), shown(F.least(F.lit(1.0), 2 * F.least("positive", "negative"))).alias("two_sided_p_value"),
        F.concat("reasons", F.coalesce("own_reasons", none)).alias("unavailable_reasons"),
    ).withColumn("available", F.size("unavailable_reasons") == 0)


def mean_inference(values: DataFrame, overlap_horizon: int = 1, minimum_lag: int = 0, block_length: int | None = None, resamples: int = 1000, seed: int = 1729) -> DataFrame:
    """Both inferences and whether their confirmation is available."""
    values = stash(renumbered(values), "renumbered")
    hac = newey_west(values, overlap_horizon, minimum_lag, dense=True)
    block = F.lit(block_length) if block_length is not None else F.greatest(F.col("hac_lag") + 1, F.lit(overlap_horizon), F.lit(1))
    boot = bootstrap_mean(values, hac.select("series", block.cast("long").alias("block_length")), resamples, seed, dense=True)
    nested = lambda df, name: df.select("series", F.struct(*[c for c in df.columns if c != "series"]).alias(name))
    both = nested(hac, "hac").join(nested(boot, "block_bootstrap"), "series")
    has = F.col("hac.hac_t_stat").isNotNull()
    ok = has & F.col("block_bootstrap.available")
    none = F.array().cast("array<string>")
    why = F.when(ok, none).otherwise(F.concat(F.when(has, none).otherwise(F.array(F.lit("hac_mean_inference_not_available"))), F.col("block_bootstrap.unavailable_reasons")))
    return both.withColumns({"confirmation_inference_available": ok, "confirmation_inference_unavailable_reasons": why})
