"""Near-duplicates by SimHash with covering locality-sensitive hashing.

Each bit of a fingerprint has a code of ``radius + 1`` bits, none of them all zero.
For every non-zero vector v there is a table that keeps the bits whose code has an odd
scalar product with v.  Up to ``radius`` differing bits give as many linear equations
for v, one fewer than it has unknowns, so some v is orthogonal to all their codes: in
its table the two fingerprints agree.  No pair within the radius is missed.

Distinct fingerprints meet in the tables.  A bucket's links are not its pairs: a search
through the bucket visits every member once and returns the links of a spanning
forest of the pairs within the radius, which has the same components.  A bucket with
more than ``at_once`` members is split by a second set of tables over the bits that
the first one leaves out; what then remains free is some 16 bits, so a bucket is
bounded by that, whatever the data.

Defined cases: a null or wordless text has the fingerprint 0 and is linked like any
other; a text of fewer words than a shingle is one shingle; repeated rows share their
fingerprint; an empty table gives an empty result.  ``component_id`` is the smallest
id that is not null.  Other columns of the input are neither read nor returned,
whatever their names, unless ``keep_one`` carries them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import resemblance
from tidegauge.llm.components import components
from tidegauge.llm.shared import drop, frugal, partitions, recorded, release, slices, stash, text_of

BITS, SEED = 64, 42
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 18


def shingle_hashes(text: str, words: int) -> list[int]:
    import xxhash

    found = text.encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not found:
        return []
    whole = b" ".join(found)
    end = np.cumsum([len(w) + 1 for w in found]) - 1
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(whole, SEED)]
    start = np.concatenate([[0], end[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return [digest(whole[a:b], SEED) for a, b in zip(start[: len(found) - words + 1].tolist(), end[words - 1 :].tolist(), strict=True)]


def fingerprints(texts, words: int) -> np.ndarray:
    """One unsigned 64-bit number for each text."""
    ones, size = np.zeros((len(texts), BITS), np.int64), np.zeros(len(texts), np.int64)
    held, at = [], []

    def count() -> None:
        if not held:
            return
        every = np.array(held, ">u8").view(np.uint8).reshape(-1, 8)
        for (row, a), b in zip(at, [*(a for _, a in at[1:]), len(held)], strict=True):
            ones[row] += np.unpackbits(every[a:b], axis=1).sum(axis=0, dtype=np.int64)

    for row, text in enumerate(texts):
        hashes = shingle_hashes(text, words)
        size[row] = len(hashes)
        for cut in range(0, len(hashes), BLOCK):
            at.append((row, len(held)))
            held += hashes[cut : cut + BLOCK]
            if len(held) >= BLOCK:
                count()
                held, at = [], []
    count()
    return np.packbits(2 * ones > size[:, None], axis=1).view(">u8").reshape(-1).astype(np.uint64)


def fingerprinted(docs: DataFrame, words: int, carry: bool = False, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Written: doc_id, fp (as a signed long), rid (a number for each row) and perhaps row."""

    @frugal
    def run(batches):
        pid, n = TaskContext.get().partitionId(), 0
        for b in (part for whole in batches for part in slices(whole, "text")):
            fp = fingerprints(b.column("text").to_pylist(), words)
            rid = (pid << 40) + n + np.arange(b.num_rows)
            n += b.num_rows
            more = ["row"] if "row" in b.schema.names else []
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64)), pa.array(rid), *(b.column(c) for c in more)], names=["doc_id", "fp", "rid", *more])

    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    plain = docs.select(F.col(id).cast("long").alias("doc_id"), text_of(text).alias("text"), *row)
    shape = "doc_id long, fp long, rid long" + (f", row {plain.schema['row'].dataType.simpleString()}" if carry else "")
    return stash(plain.mapInArrow(run, shape), "fingerprints")


def masks(radius: int, places: list[int]) -> list[int]:
    """The tables' masks over the given bit places, as signed 64-bit numbers."""
    vectors = range(1, 1 << (radius + 1))
    code = {p: i % len(vectors) + 1 for i, p in enumerate(places)}
    found = [sum(1 << p for p, c in code.items() if (c & v).bit_count() % 2) for v in vectors]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in found]


def forest(members: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of a spanning forest of all pairs within the radius."""
    links, left = [], members
    while len(left) > 1:
        queue, left = [left[:1]], left[1:]
        while queue and len(left):
            some = queue.pop()
            for x in some:
                near = np.bitwise_count(left ^ x) <= radius
                if near.any():
                    found = left[near]
                    links.append((np.full(len(found), x), found))
                    queue.append(found)
                    left = left[~near]
                    if not len(left):
                        break
    return links


def _searched(buckets: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) within buckets (members: array of long)."""

    @frugal
    def run(batches):
        for b in batches:
            links = [link for m in b.column("members") for link in forest(np.array(m.values).view(np.uint64), radius)]
            for a, c in links:
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(c.view(np.int64))], names=["a", "b"])

    return buckets.select("members").mapInArrow(run, "a long, b long")


def near_links(distinct: DataFrame, radius: int, at_once: int = 4096) -> DataFrame:
    """Links (a, b) that connect all fingerprints ``fp`` within the radius of each other."""
    tables = masks(radius, list(range(BITS)))
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(tables)])
    placed = distinct.select("fp", F.inline(keys))
    # Most buckets with company have two members, which their smallest and largest tell.
    met = stash(placed.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "buckets")
    pairs = met.where("n = 2").select("a", "b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    some = placed.join(met.where(f"n > 2 and n <= {at_once}").select("t", "key"), ["t", "key"]).groupBy("t", "key").agg(F.collect_list("fp").alias("members"))
    second = [masks(radius, [p for p in range(BITS) if not (m >> p) & 1]) for m in tables]
    finer = F.array(*[F.struct(F.lit(s).alias("s"), F.col("fp").bitwiseAND(F.element_at(F.array(*[F.lit(of[s]) for of in second]), F.col("t") + 1)).alias("key2")) for s in range(len(tables))])
    crowd = placed.join(met.where(f"n > {at_once}").select("t", "key"), ["t", "key"]).select("t", "key", "fp", F.inline(finer))
    crowd = crowd.groupBy("t", "key", "s", "key2").agg(F.collect_list("fp").alias("members")).where("size(members) > 1")
    return pairs.union(_searched(some.union(crowd.select("t", "key", "members")), radius))


def _linked(fps: DataFrame, radius: int, at_once: int) -> DataFrame:
    """fp, component_id and first (the row that stands for the component) of each
    distinct fingerprint."""
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "rid")
    distinct = stash(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(first).alias("first")), "distinct")
    stars = components(near_links(distinct.select("fp"), radius, at_once))
    member = stars.union(stars.select("root", "root").distinct()).toDF("fp", "root")
    of = member.join(distinct, "fp")
    roots = of.groupBy("root").agg(F.min("least").alias("component_id"), F.min("first").alias("component_first"))
    linked = of.select("fp", "root").join(roots, "root").drop("root")
    joined = distinct.join(linked, "fp", "left")
    # Written, so that the join with the rows stands on its own and Spark can split a
    # fingerprint that very many rows share.
    return stash(joined.select("fp", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("component_first", "first").alias("first")), "linked")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, at_once: int = 4096, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint and component_id of each row."""
    fps = fingerprinted(docs, words, text=text, id=id)
    joined = fps.join(_linked(fps, radius, at_once), "fp")
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def proposals(rows: DataFrame, words: int, radius: int, at_once: int) -> DataFrame:
    """Written: links (a, b) between rows (rid, text) that connect all whose fingerprints are
    within the radius of each other."""
    with recorded(made := []):
        fps = fingerprinted(rows, words, id="rid").select("fp", F.col("doc_id").alias("rid"))
        first = stash(fps.groupBy("fp").agg(F.min("rid").alias("first")), "distinct")
        # A written table of fingerprints is a few files, but each one is placed in all tables.
        dealt = first.select("fp").repartition(partitions(rows.sparkSession), "fp")
        near = stash(near_links(dealt, radius, at_once).distinct(), "fingerprint-links")
    between = near.join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    within = fps.join(first, "fp").where("first < rid").select("first", "rid")
    found = stash(between.union(within).distinct(), "proposals")
    drop(rows.sparkSession, made)
    release(rows.sparkSession)
    return found


def keep_one(docs: DataFrame, words: int = 4, radius: int = 4, at_once: int = 4096, similarity: bool = False, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The row with the smallest id of each component, with all columns of ``docs``.

    With ``similarity`` texts are linked by a Jaccard similarity of their shingles of 0.8
    or more.  Links between fingerprints are then confirmed by the exact similarity.  Such
    texts may also have fingerprints some 10 bits apart, too far for masks, so what the
    fingerprints leave apart is found by the sets of shingles (see ``resemblance``).
    """
    if similarity:
        rows = resemblance.numbered(docs, text, id)
        texts = rows.select("rid", text_of(f"row.{text}").alias("text"))
        return resemblance.keep_first(rows, resemblance.links(texts, words, proposals(texts, words, radius, at_once)))
    fps = fingerprinted(docs, words, carry=True, text=text, id=id)
    firsts = _linked(fps.select("doc_id", "fp", "rid"), radius, at_once).select(F.col("first.rid").alias("rid")).distinct()
    return fps.join(firsts, "rid").select("row.*")
