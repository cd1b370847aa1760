"""Mixing sources to target weights along a curriculum that changes over time.

Every source has a target, the words that training takes of it, and a schedule, how
its share of the stream changes over training time from 0 to 1.  The schedule's
integral, scaled to the target, is the source's cumulative demand; the place where
that demand reaches a document's first word, found by inverting the integral, is
the document's training position.  Documents sorted by position are the stream.

Documents of a source stand in the order of a hash of id and text.  Their running
sums come in two steps, sums of hash ranges first and sums within each range
after, so a source with any share of the rows is dealt over many tasks and the
result does not depend on how it was dealt.

Defined cases: a null text has size 0 and null is a source of its own, the last.
Sources whose sizes are 0 get the target 0.  Ties in the hash go by id, then size;
repeated rows stand one after the other and are taken each for itself.  A document
that the remainder of a target ends in is taken in part.  An empty table gives an
empty result.  Columns of the input are packed in one struct, so their names cannot
clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.shared import stash, text_of

#: Relative weight at equally spaced times from 0 to 1, for each kind of source.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
WORDS = r"[^\x20\x09-\x0D]+"
#: Leading hexadecimal digits of the hash that make a range.
RANGE_DIGITS = 3


def targets(sizes: DataFrame, weights: Sequence[float], share: float, repeats: float) -> DataFrame:
    """Adds kind and target to one row for each source (source, source_size).

    Targets are level * weight, but no more than ``repeats`` times the size, where
    the level makes them add up to ``share`` of all sizes.  Sorted by cap / weight,
    the sources at their caps come first; the level is that of the first source
    which stays below its cap once all before it are at theirs.
    """
    by_name, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sizes.withColumn("kind", (F.row_number().over(by_name) - 1) % len(weights))
    weighed = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), F.col("kind") + 1)).withColumn("cap", F.col("source_size") * float(repeats))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    spread = (
        weighed.withColumn("left", F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.when(F.col("left") / F.col("open") * F.col("weight") <= F.col("cap"), F.col("left") / F.col("open")))
    )
    level = F.first("level", ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return spread.select("source", "source_size", "kind", "cap", "weight", level.alias("level")).select("source", "source_size", "kind", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), "cap")).alias("target"))


def position(part: Column, kind: Column, schedules: Sequence[Sequence[float]] = SCHEDULES) -> Column:
    """The time at which a source of this kind has met ``part`` of its demand."""
    by_kind = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        step = 1.0 / (len(knots) - 1)
        areas = [(a + b) / 2 * step for a, b in pairwise(knots)]
        need, value = part * sum(areas), F.lit(1.0)
        for i in reversed(range(len(areas))):
            a, b, rest = knots[i], knots[i + 1], need - sum(areas[:i])
            # rest = a x + (b - a) / (2 step) x^2, solved without cancellation
            root = 2 * rest / (a + F.sqrt(F.greatest(F.lit(0.0), a * a + 2 * (b - a) / step * rest)))
            value = F.when(need < sum(areas[: i + 1]), i * step + F.coalesce(root, F.lit(0.0))).otherwise(value)
        by_kind = F.when(kind == k, value).otherwise(by_kind)
    return by_kind


def assign(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, repeats: float = 2, schedules=SCHEDULES, carry: bool = False, text: str = "text", id: str = "doc_id", source: str = "source") -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken and uses,
    an array of (position, words) for each time it is read; with ``carry`` also
    ``row``, the whole input row."""
    kinds = len(schedules)
    if kinds != len(weights):
        raise ValueError("one schedule for each weight is needed")
    key = F.md5(F.concat_ws(":", F.col(id).cast("string"), F.col(text)).cast("binary"))
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    sized = docs.select(*row, F.col(id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.regexp_count(text_of(text), F.lit(WORDS)).cast("long").alias("size"), key.alias("key"))
    # A source's name, with null told apart, and the range of the hash.
    sized = sized.withColumns({"name": F.coalesce(F.concat(F.lit("="), "source"), F.lit("")), "range": F.substring("key", 1, RANGE_DIGITS)})
    if not carry:
        sized = stash(sized, "sizes")
    sums = stash(sized.groupBy("name", "source", "range").agg(F.sum("size").alias("sum")), "size-sums")
    sources = targets(sums.groupBy("source").agg(F.sum("sum").alias("source_size")), weights, share, repeats).withColumn("name", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    earlier = Window.partitionBy("name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sums.select("name", "range", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("before")).join(sources, "name")
    within = Window.partitionBy("name", "range").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.join(ranges, ["name", "range"]).withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    words = F.round("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    placed = placed.withColumn("full", full).withColumn("rest", F.greatest(F.lit(0), F.least("size", words - F.col("full") * F.col("source_size") - F.col("at"))))

    def use(n: Column, taken: Column) -> Column:
        part = (n * F.col("source_size") + F.col("at")) / F.greatest(F.lit(1.0), F.col("target"))
        return F.struct(position(part, F.col("kind"), schedules).alias("position"), taken.alias("words"))

    # A document is read once for each full pass and once more, perhaps in part, for the rest.
    uses = F.concat(*[F.when((F.col("full") > n) & (F.col("size") > 0), F.array(use(F.lit(n), F.col("size")))).otherwise(F.array()) for n in range(int(repeats))], F.when(F.col("rest") > 0, F.array(use(F.col("full"), F.col("rest")))).otherwise(F.array()))
    taken = F.col("full") * F.col("size") + F.col("rest")
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), uses.alias("uses"), *(["row"] if carry else []))


def training_order(assigned: DataFrame) -> DataFrame:
    """The stream: a row for each reading of a document, range-sorted by position."""
    read = assigned.select("*", F.inline("uses")).drop("uses")
    return read.orderBy("position", "doc_id")


def mixed_rows(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """The stream with the columns of ``docs``: a row as often as it is read, its
    text cut at the words taken where the rest of a target ends in it."""
    stream = training_order(assign(docs, carry=True, text=text, **how))
    parts = F.expr(rf"array_join(slice(filter(split(row.`{text}`, '[\\x20\\x09-\\x0D]+'), w -> w != ''), 1, cast(words as int)), ' ')")
    return stream.select(*[F.when(F.col("words") < F.col("size"), parts).otherwise(F.col(f"row.`{c}`")).alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns])
