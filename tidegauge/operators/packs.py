"""Many small artifacts in few bounded parts, with identity and exact content."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.ordering import placed, same_keys

IDENTITY = ("unit", "kind", "name")
MEMBERS, PART_BYTES = 1024, 64 << 20


#: Artifacts whose parts one task lays out.
BLOCK = 1 << 16


def next_starts(sizes: np.ndarray, max_members: int, max_bytes: int) -> np.ndarray:
    """Where the next part starts if one starts at each place: past ``max_members``, or
    before the first artifact that would exceed ``max_bytes``; one artifact always fits."""
    ends = np.cumsum(sizes)
    by_bytes = np.searchsorted(ends, ends - sizes + max_bytes, "right")
    at = np.arange(len(sizes))
    return np.minimum(np.maximum(by_bytes, at + 1), at + max_members)


def _followed(next_: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each place, if a part starts there: the first start past ``own``, how many
    parts start before that, and the last of those, by doubling of the jumps."""
    at, n, last = next_[:own].copy(), np.ones(own, np.int64), np.arange(own)
    while len(inside := np.flatnonzero(at < own)):
        to = at[inside]
        n[inside], last[inside], at[inside] = n[inside] + n[to], last[to], at[to]
    return at, n, last


def plan_parts(artifacts: DataFrame, max_members: int = MEMBERS, max_bytes: int = PART_BYTES, buckets: int = 1) -> DataFrame:
    """Adds part and member of each artifact (unit, kind, name, bytes), whose identities differ.

    In the order of the identity a part takes artifacts while it has room for members
    and bytes; only an artifact that is larger alone exceeds the bytes.  Blocks of places, with
    the next ``max_members`` places, tell where a part that starts at one of their first
    places leads beyond them; following these maps, one for each block, gives the
    place where each block's first part starts, and blocks number their parts from there.
    """
    if max_members < 1 or max_bytes < 1:
        raise ValueError("a part needs room")
    size = max(BLOCK, 4 * max_members)
    light = artifacts.select(*IDENTITY, F.coalesce("bytes", F.lit(0)).cast("long").alias("_bytes"), F.pmod(F.xxhash64(*IDENTITY), F.lit(buckets)).cast("int").alias("_bucket"))
    rows = placed(light, ["_bucket"], IDENTITY).drop("_part", "_total")
    block = F.floor(F.col("_place") / size)
    # The first places of a block also stand after the one before.
    early = (F.col("_place") % size < max_members) & (block > 0)
    dealt = rows.select("_bucket", "_place", "_bytes", F.explode(F.when(early, F.array(block - 1, block)).otherwise(F.array(block))).alias("_block"))

    def ordered(group: pa.Table) -> tuple[np.ndarray, int, int, int]:
        group = group.sort_by("_place")
        first = group.column("_block")[0].as_py() * size
        return group.column("_bytes").to_numpy(), group.column("_bucket")[0].as_py(), first, min(size, group.num_rows)

    def leads(group: pa.Table) -> pa.Table:
        sizes, bucket, first, own = ordered(group)
        entries = min(own, max_members)
        out = [x[:entries] for x in _followed(next_starts(sizes, max_members, max_bytes), own)]
        return pa.table({"_bucket": pa.array([bucket], pa.int32()), "_block": [first // size], "leaves": pa.array([out[0] + first]), "parts": pa.array([out[1]]), "last": pa.array([out[2] + first])})

    maps = dealt.groupBy("_bucket", "_block").applyInArrow(leads, "_bucket int, _block long, leaves array<long>, parts array<long>, last array<long>")
    n = int(artifacts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def follow(batches):
        bucket, entry, number, last = None, 0, 0, 0
        for b in batches:
            out = []
            for row in b.to_pylist():
                if row["_bucket"] != bucket:
                    bucket, entry, number, last = row["_bucket"], 0, 0, 0
                k = entry - row["_block"] * size
                out.append((bucket, row["_block"], entry, number, last))
                if k < len(row["leaves"]):  # else the last block ends before the entry
                    entry, number, last = row["leaves"][k], number + row["parts"][k], row["last"][k]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), entered, strict=True)] if out else [pa.array([], t) for t in entered], names=["_bucket", "_block", "entry", "number", "last"])

    entered = [pa.int32(), *[pa.int64()] * 4]
    chained = maps.repartition(n, "_bucket").sortWithinPartitions("_bucket", "_block").mapInArrow(follow, "_bucket int, _block long, entry long, number long, last long")

    def numbered(_, group: pa.Table, where: pa.Table) -> pa.Table:
        sizes, bucket, first, own = ordered(group)
        entry, number, last = (where.column(c)[0].as_py() for c in ("entry", "number", "last"))
        next_, starts, at = next_starts(sizes, max_members, max_bytes), [], entry - first
        while at < own:
            starts.append(at)
            at = int(next_[at])
        place = np.arange(own)
        turn = np.searchsorted(starts, place, "right")
        begin = np.array([last - first, *starts])[turn]
        return pa.table({"_bucket": pa.array(np.full(own, bucket, np.int32)), "_place": place + first, "_number": turn + number - 1, "member": (place - begin + 1).astype(np.int32)})

    shape = "_bucket int, _place long, _number long, member int"
    found = dealt.groupBy("_bucket", "_block").cogroup(chained.groupBy("_bucket", "_block")).applyInArrow(numbered, shape)
    part = F.format_string("%06d-%012d", "_bucket", "_number").alias("part")
    planned = rows.join(found, ["_bucket", "_place"]).select(*IDENTITY, part, "member")
    return same_keys(artifacts, planned, IDENTITY)


def publication_errors(artifacts: DataFrame) -> DataFrame:
    """Artifacts (.., sha256, content) that forbid publication: wrong content, or an
    identity used twice."""
    wrong = artifacts.where(~F.sha2("content", 256).eqNullSafe(F.col("sha256"))).select(*IDENTITY, F.lit("content_hash_mismatch").alias("error"))
    twice = artifacts.groupBy(*IDENTITY).count().where("count > 1").select(*IDENTITY, F.lit("duplicate_identity").alias("error"))
    return wrong.unionByName(twice)


def publish(artifacts: DataFrame, path: str, max_members: int = MEMBERS, max_bytes: int = PART_BYTES, buckets: int = 1) -> DataFrame:
    """Write the pack and return its catalog; nothing is written on an error or without input."""
    if artifacts.limit(1).isEmpty():
        raise ValueError("nothing to pack")
    if bad := publication_errors(artifacts).limit(5).collect():
        raise ValueError(f"not published: {[r.asDict() for r in bad]}")
    planned = plan_parts(artifacts.withColumn("bytes", F.length("content")), max_members, max_bytes, buckets)
    planned.repartition("part").sortWithinPartitions("part", "member").write.partitionBy("part").parquet(path)
    return artifacts.sparkSession.read.parquet(path).drop("content")


def member_errors(pack: DataFrame) -> DataFrame:
    """Members whose size or hash is not what the catalog says."""
    return pack.where(~F.length("content").eqNullSafe(F.col("bytes")) | ~F.sha2("content", 256).eqNullSafe(F.col("sha256"))).select(*IDENTITY, "part", "member")


def catalog_totals(catalog: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Artifacts, distinct units and bytes, counted exactly: units first, then their number."""
    each = catalog.groupBy(*keys, "unit").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    return each.groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("artifacts"), F.count("*").alias("units"), F.coalesce(F.sum("b"), F.lit(0)).alias("logical_bytes"))


def total_errors(catalog: DataFrame, manifest: dict[str, int]) -> list[str]:
    """Totals of a manifest that the catalog does not have."""
    have = catalog_totals(catalog).first().asDict()
    return sorted(k for k, v in manifest.items() if have.get(k) != v)


def lookup(pack: DataFrame, wanted: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The wanted artifacts (unit, kind, name), ordered by part and member."""
    return pack.join(wanted.select(*IDENTITY).distinct(), list(IDENTITY), "left_semi").select(*(columns or pack.columns)).orderBy(*(["part", "member"] if not columns or {"part", "member"} <= set(columns) else columns))


def receipt_errors(receipts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Units whose receipt (unit, artifacts: map of name to hash) is not exactly what the
    catalog (unit, name, sha256) holds, or that have not exactly one receipt."""
    several = receipts.groupBy("unit").count().where("count <> 1").select("unit", F.lit(None).cast("string").alias("name"), F.lit("receipt_count").alias("error"))
    stated = receipts.select("unit", F.explode("artifacts").alias("name", "stated")).distinct()
    held = catalog.select("unit", "name", F.col("sha256").alias("held")).distinct()
    joined = stated.join(held, ["unit", "name"], "full_outer")
    error = F.when(F.col("held").isNull(), "not_in_catalog").when(F.col("stated").isNull(), "not_in_receipt").when(F.col("held") != F.col("stated"), "hash_mismatch")
    return joined.select("unit", "name", error.alias("error")).where("error is not null").unionByName(several)


def inventory(artifacts: DataFrame, keys: tuple[str, ...] = ("stage",)) -> DataFrame:
    """Count, bytes and a digest of the list (name, sha256, bytes) of each group.

    The digest is made of sums of the entries' hashes, so no list is gathered and
    order does not matter."""
    entry = F.sha2(F.concat_ws("|", "name", "sha256", F.col("bytes").cast("string")), 256)
    slices = [F.sum(F.conv(F.substring(entry, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return artifacts.groupBy(*keys).agg(F.count("*").alias("artifacts"), F.sum("bytes").alias("total_bytes"), F.sha2(F.concat_ws("|", F.count("*").cast("string"), *slices), 256).alias("list_sha256"))
