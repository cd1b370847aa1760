"""Exact deduplication by sorting content.

Texts are normalised, rows are dealt to ranges of (leading bytes, digest, id)
between sampled splitters, each range is sorted externally so that equal texts
stand together, and one scan compares each text with its neighbour in full.
Because the id takes part in the ranges, a text with very many copies spans
several ranges and no task has to take all of them.  Only the first and last run
of a range can continue in another range; those, at most two for each range, are
afterwards grouped by their whole texts.

Splitters are sampled from the first ``LEADING`` characters and the digest, so
that long texts never travel to the driver whole.

Defined cases: a null text is the empty text.  Runs of white space count as one
space but are not trimmed.  Of equal texts the row with the smallest id stays;
null ids come after all others.  Of rows that repeat an id with the same text
one stays.  An empty table gives an empty result.  Other columns of the input
are neither read nor returned, whatever their names, unless ``drop_copies``
carries them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.shared import frugal, BLANKS, stash, text_of

LEADING = 64
#: The range, whether the run is its first (0) or last one (1) or neither (-1), whether the row is the run's
#: head, the head's id, the run's rows, and the text of heads of first and last runs.
MARKS = T.StructType([T.StructField(*f) for f in (("pid", T.IntegerType()), ("edge", T.IntegerType()), ("head", T.BooleanType()), ("keep_id", T.LongType()), ("group_size", T.LongType()), ("edge_text", T.StringType()))])


def normalised(text) -> F.Column:
    return F.regexp_replace(text_of(text), BLANKS, " ")


def _fresh(b: pa.RecordBatch, last: str | None) -> np.ndarray:
    """Which rows of a sorted batch have another text than the row before."""
    text, fresh = b.column("text"), np.empty(b.num_rows, bool)
    fresh[0] = last is None or text[0].as_py() != last
    fresh[1:] = pc.not_equal(text[1:], text[:-1]).to_numpy(zero_copy_only=False)
    return fresh


@frugal
def _groups(batches):
    """All rows of one range, with the head and size of their runs.

    Rows of the run that is still open wait, without their texts, until it ends.
    """
    pid, run, last, first_text, waiting = TaskContext.get().partitionId(), -1, None, None, []

    def closed(rows: pa.Table, at: np.ndarray, final: bool):
        """Rows whose runs (numbers in ``at``) have ended."""
        if not len(at):
            return
        _, first, where, size = np.unique(at, return_index=True, return_inverse=True, return_counts=True)
        edge = np.where(at == 0, 0, np.where((at == at[-1]) & final, 1, -1))
        text = [None] * len(at)
        for i in first[edge[first] >= 0].tolist():
            text[i] = last if edge[i] else first_text
        ids = rows.column("doc_id").combine_chunks()
        columns = [ids, rows.column("sha"), pa.array(np.full(len(at), pid, np.int32)), pa.array(edge.astype(np.int32)), pa.array(np.isin(np.arange(len(at)), first)), ids.take(pa.array(first[where])), pa.array(size[where].astype(np.int64)), pa.array(text, pa.string())]
        yield from pa.Table.from_arrays(columns, names=["doc_id", "sha", *MARKS.names]).to_batches(max_chunksize=10_000)

    for b in batches:
        if not b.num_rows:
            continue
        at = run + np.cumsum(_fresh(b, last))
        rows = pa.Table.from_batches([b]).select(["doc_id", "sha"])
        first_text = b.column("text")[0].as_py() if first_text is None else first_text
        cut = int(np.searchsorted(at, at[-1]))  # where the run that stays open begins
        if at[-1] == run:
            waiting.append((rows, at))
        else:
            ended = [*waiting, (rows.slice(0, cut), at[:cut])]
            yield from closed(pa.concat_tables([r for r, _ in ended]), np.concatenate([a for _, a in ended]), False)
            waiting = [(rows.slice(cut), at[cut:])]
        run, last = int(at[-1]), b.column("text")[b.num_rows - 1].as_py()
    if waiting:
        yield from closed(pa.concat_tables([r for r, _ in waiting]), np.concatenate([a for _, a in waiting]), True)


@frugal
def _heads(batches):
    """The first row of each run of one range; of a run with very many rows no other is held."""
    pid, last, text, open_, edge = TaskContext.get().partitionId(), None, None, None, 0

    def marked(rows: pa.Table, edge: int, text: str | None):
        n = len(rows)
        marks = [pa.array([x] * n, t) for x, t in ((pid, pa.int32()), (edge, pa.int32()), (True, pa.bool_()))]
        return pa.Table.from_arrays([rows.column("doc_id"), rows.column("sha"), rows.column("row"), *marks, rows.column("doc_id"), pa.array([0] * n, pa.int64()), pa.array([text] * n, pa.string())], names=["doc_id", "sha", "row", *MARKS.names]).to_batches()

    for b in batches:
        if not b.num_rows:
            continue
        heads = pa.Table.from_batches([b.filter(pa.array(_fresh(b, last)))])
        last = b.column("text")[b.num_rows - 1].as_py()
        if not len(heads):
            continue
        if open_ is not None:
            yield from marked(open_, edge, text)
            edge = -1
        else:
            text = heads.column("text")[0].as_py()
            if len(heads) > 1:
                yield from marked(heads.slice(0, 1), 0, text)
                heads, edge = heads.slice(1), -1
        yield from marked(heads.slice(0, len(heads) - 1), -1, None)
        open_, text = heads.slice(len(heads) - 1), last if edge else text
    if open_ is not None:
        yield from marked(open_, 1 if edge else 0, last)


def _marked(docs: DataFrame, text: str, id: str, carry: bool) -> DataFrame:
    """Written: doc_id, sha and marks within the range; with ``carry`` only the head of
    each run, with its whole input row."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    sha = F.sha2(F.encode(normalised(text), "UTF-8"), 256)
    keyed = docs.select(*([whole] if carry else []), text_of(text).alias("raw"), F.col(id).cast("long").alias("doc_id"), F.substring(normalised(text), 1, LEADING).alias("leading"), sha.alias("sha"))
    if carry:
        keyed = keyed.drop("raw")
    dealt = keyed.repartitionByRange("leading", "sha", F.col("doc_id").asc_nulls_last())
    sorted_ = dealt.withColumn("text", normalised(f"row.{text}" if carry else "raw")).sortWithinPartitions("leading", "sha", "text", F.col("doc_id").asc_nulls_last())
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("sha", T.StringType()), *([T.StructField("row", sorted_.schema["row"].dataType)] if carry else []), *MARKS])
    scanned = sorted_.select("text", "doc_id", "sha", *(["row"] if carry else [])).mapInArrow(_heads if carry else _groups, out)
    return stash(scanned, "exact-runs")


def _edges(marked: DataFrame) -> DataFrame:
    """One row for each first or last run of a range, at most two for each, with what all runs of its text have."""
    each = stash(marked.where("edge >= 0 and head").select("pid", "edge", "sha", "edge_text", "keep_id", "group_size"), "exact-edges")
    first = F.min_by(F.struct("pid", "edge"), F.struct(F.col("keep_id").isNull(), "keep_id", "pid")).alias("first")
    texts = each.groupBy("sha", "edge_text").agg(F.min("keep_id").alias("edge_keep"), F.sum("group_size").alias("edge_size"), first)
    return each.join(texts.hint("merge"), ["sha", "edge_text"]).select("pid", "edge", "edge_keep", "edge_size", (F.col("first.pid") == F.col("pid")).alias("leads"))


def exact_groups(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    marked = _marked(docs, text, id, carry=False)
    # _edges has at most two rows for each range, so it may be broadcast.
    joined = marked.join(F.broadcast(_edges(marked)), ["pid", "edge"], "left")
    whole = F.col("leads").isNotNull()
    return joined.select(
        "doc_id",
        F.when(whole, F.col("edge_keep")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(whole, F.col("edge_size")).otherwise(F.col("group_size")).alias("group_size"),
        (F.col("head") & F.coalesce("leads", F.lit(True))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    marked = _marked(docs, text, id, carry=True)
    return marked.join(F.broadcast(_edges(marked)), ["pid", "edge"], "left").where("coalesce(leads, true)").select("row.*")
