"""What may be retired: references in documents, their closure, and conflicts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.sources.tables import fresh_folder, stash

#: Paths under these roots are references (a fixed value).
PATH = r"((?:workspace_out|data_lake)/[^\n\r\"<>|\s]+)"


def references(documents: DataFrame, known: DataFrame) -> DataFrame:
    """(src, dst) of each path and each known name (known: name) that a document (path,
    text) mentions."""
    paths = documents.select(F.col("path").alias("src"), F.explode(F.regexp_extract_all(F.replace("text", F.lit("\\"), F.lit("/")), F.lit(PATH), F.lit(1))).alias("dst"))
    trimmed = paths.select("src", F.regexp_replace("dst", "[`;,)]+$", "").alias("dst"))
    tokens = documents.select(F.col("path").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Za-z0-9_.-]+)"), F.lit(1)))).alias("dst"))
    names = tokens.join(known.select(F.col("name").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
    return trimmed.unionByName(names).distinct()


def closure(edges: DataFrame, roots: DataFrame, max_rounds: int | None = None) -> tuple[DataFrame, bool]:
    """Nodes that the roots (node) reach over edges (src, dst), roots included, and
    whether the search came to its end; without ``max_rounds`` it goes on until it does.

    Edges are written once, bucketed by source, and what was seen is bucketed by node
    and only added to.  So a round deals out its frontier alone: neither edges nor
    nodes seen before are computed, dealt or written again.
    """
    spark, id = edges.sparkSession, uuid.uuid4().hex
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = fresh_folder(spark, "closure")

    def kept(df: DataFrame, name: str, by: str) -> None:
        df.write.mode("append").bucketBy(n, by).sortBy(by).option("path", f"{folder}/{name}").saveAsTable(f"{name}_{id}")

    links = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    kept(links, "closure_edges", "src")
    frontier = stash(roots.select("node").where("node is not null").distinct(), "frontier")
    rounds, complete = 0, False
    try:
        kept(frontier, "closure_seen", "node")
        while not complete and (max_rounds is None or rounds < max_rounds):
            found = spark.table(f"closure_edges_{id}").join(frontier.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node")).distinct()
            frontier = stash(found.join(spark.table(f"closure_seen_{id}"), "node", "left_anti"), "frontier")
            rounds, complete = rounds + 1, frontier.limit(1).isEmpty()
            if not complete:
                kept(frontier, "closure_seen", "node")
        schema = spark.table(f"closure_seen_{id}").schema
    finally:
        # Only the catalog's entries go; the rows are read by path.
        for name in ("closure_edges", "closure_seen"):
            spark.sql(f"drop table if exists {name}_{id}")
    return spark.read.schema(schema).parquet(f"{folder}/closure_seen"), complete


def ancestors(path: Column) -> Column:
    """A path and all paths above it."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def is_latest(path: Column) -> Column:
    name = F.upper(F.element_at(F.split(path, "/"), -1))
    return name.startswith("LATEST") | F.array_contains(F.split(name, "[_.-]"), "LATEST")


def retirement_conflicts(candidates: DataFrame, protected: DataFrame, complete: bool = True) -> DataFrame:
    """Candidates (path) that may not go, and why: they are, hold or lie under a
    protected path (path), or are a latest publication, or the graph is incomplete.

    Both sides are unfolded to the paths above them, so equal paths meet and nothing
    else does.
    """
    plain = lambda c: F.array_join(F.filter(F.split(c, "/"), lambda p: p != ""), "/")
    wanted = candidates.select("path", plain(F.col("path")).alias("p")).where("p <> ''").distinct()
    held = protected.select(plain(F.col("path")).alias("q")).where("q <> ''").distinct()
    inside = wanted.select("path", F.explode(ancestors(F.col("p"))).alias("q")).join(held, "q", "left_semi").select("path")
    above = held.select(F.explode(ancestors(F.col("q"))).alias("p")).distinct()
    holds = wanted.join(above, "p", "left_semi").select("path")
    conflicts = inside.union(holds).distinct().select("path", F.lit("referenced_or_protected").alias("reason"))
    conflicts = conflicts.union(wanted.where(is_latest(F.col("p"))).select("path", F.lit("canonical_latest_not_retirable")))
    if not complete:
        conflicts = conflicts.union(wanted.select("path", F.lit("incomplete_retention_graph")))
    return conflicts.distinct()


def retirable(candidates: DataFrame, protected: DataFrame, complete: bool = True) -> DataFrame:
    return candidates.join(retirement_conflicts(candidates, protected, complete).select("path"), "path", "left_anti")
