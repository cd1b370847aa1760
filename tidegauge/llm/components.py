"""Connected components of a graph given as links, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.shared import stash


def _least(links: DataFrame) -> DataFrame:
    """Each node's smallest neighbour, itself included, beside each of its links.

    Minima are taken before rows meet, and the join can be split by Spark where one
    node has very many links.
    """
    least = links.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
    return links.join(least, "a")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long), root being the smallest
    node of its component; roots are not nodes of the result.

    Large and small stars alternate: a node links its larger neighbours, then its
    smaller ones, to the smallest of all.  Each round is written, and the rounds end
    when links stay the same; their number grows with the logarithm of the size.
    """
    stars = stash(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    state = None
    while True:
        both = stars.union(stars.select("b", "a"))
        large = _least(both).where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        down = _least(stash(large.distinct(), "large-stars"))  # here every b is smaller than its a
        small = down.select("b", "least").union(down.select("a", "least")).toDF("a", "b").where("a <> b").distinct()
        stars = stash(small, "stars")
        now = stars.select(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(a, b))"), F.lit(0))).first()
        if tuple(now) == state:
            return stars.toDF("node", "root")
        state = tuple(now)
