"""Immutable snapshots of dated tables: content reuse, verification, difference.

Content is known by a digest of the multiset of a date's rows, so neither the order
of rows nor the layout of files matters.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.clocks import strict_date
from tidegauge.sources.tables import selected, stash

SEMANTICS = ("universe", "price_basis", "frequency", "availability", "role")
MANIFEST = "snapshot_id string, source string, date string, digest string, rows long, bytes long"
OBJECTS = "digest string, rows long, bytes long, symbols array<string>, low string, high string"
SNAPSHOTS = "snapshot_id string, schema string, date_column string"
#: The column that names the object of a stored row; sources may not have it.
OBJECT = "_digest"
#: The column that objects are indexed by besides their date, and symbols that an object's entry lists; beyond that it has their ends.
SYMBOL, LISTED = "symbol", 64


def _plain(df: DataFrame):
    """Columns in order, with -0.0 and NaN in one form and clocks as numbers."""
    for f in sorted(df.schema.fields, key=lambda f: f.name):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.FloatType | T.DoubleType):
            c = F.when(F.isnan(c), float("nan")).otherwise(c + F.lit(0.0))
        elif isinstance(f.dataType, T.TimestampType):
            c = F.unix_micros(c)
        yield c.alias(f.name)


def date_digests(df: DataFrame, date: str = "date", by: str | None = None) -> DataFrame:
    """date, digest, rows and bytes of each date's rows; with ``by``, a column that is
    not part of the content, of each of its values and date.

    Each row is hashed where it is read; four slices of the hash are summed, which
    adds up on the map side and does not depend on order.
    """
    keys = ["date"] if by is None else [by, "date"]
    content = df if by is None else df.drop(by)
    shape = hashlib.sha256(json.dumps(sorted((f.name, f.dataType.simpleString()) for f in content.schema.fields)).encode()).hexdigest()
    text = F.to_json(F.struct(*_plain(content)), {"ignoreNullFields": "false"})
    rows = df.select(*keys[:-1], F.col(date).cast("string").alias("date"), text.alias("text")).withColumn("hash", F.sha2("text", 256))
    parts = [F.sum(F.conv(F.substring("hash", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"s{i}") for i in range(4)]
    found = rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes"), *parts)
    return found.select(*keys, F.sha2(F.concat_ws("|", F.lit(shape), "date", "rows", "s0", "s1", "s2", "s3"), 256).alias("digest"), "rows", "bytes")


def snapshot_manifest(sources: dict[str, DataFrame], semantics: dict[str, str], date: str = "date") -> tuple[str, DataFrame]:
    """The id and the manifest of a snapshot of these sources, without writing it."""
    if missing := [s for s in SEMANTICS if not str(semantics.get(s, "")).strip()]:
        raise ValueError(f"semantics not stated: {missing}")
    if not sources:
        raise ValueError("a snapshot needs a source")
    shapes = {tuple((f.name, f.dataType.simpleString()) for f in df.schema.fields) for df in sources.values()}
    if len(shapes) > 1:
        raise ValueError("sources differ in schema")
    for name, df in sources.items():
        if df.where(strict_date(F.col(date).cast("string")).isNull()).limit(1).count():
            raise ValueError(f"{name}: dates must be ISO and not null")
    rows = None
    for name, df in sources.items():
        one = date_digests(df, date).withColumn("source", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    # One number for all digests; the manifest itself has a row for each date.
    content = rows.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws("|", "source", "date", "digest"))), ","), 256)).first()[0]
    head = {"semantics": {s: semantics[s] for s in SEMANTICS}, "sources": sorted(sources), "schema": sorted(next(iter(shapes))), "content": content}
    id = hashlib.sha256(json.dumps(head, sort_keys=True).encode()).hexdigest()
    return id, rows.select(F.lit(id).alias("snapshot_id"), "source", "date", "digest", "rows", "bytes")


def _table(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A table of the store, empty before its first write."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def _objects(store: str, schema: str) -> str:
    """Where objects of a schema lie: rows of different schemas are never read together."""
    return f"{store}/objects/{hashlib.sha256(schema.encode()).hexdigest()}"


def freeze(store: str, sources: dict[str, DataFrame], semantics: dict[str, str], date: str = "date", salt: int = 1) -> dict:
    """Write what is new of a snapshot and return its id, rows, added and reused bytes.

    Objects are stored once for each digest, also if several sources hold the same.
    ``salt`` files are written for each date, for dates that are large.  Objects come
    first, then their index, the manifest and the snapshot's head; a run that ends in
    between leaves nothing that counts, and the next one overwrites its objects.
    """
    some = next(iter(sources.values()), None)
    if some is not None and OBJECT in some.columns:
        raise ValueError(f"sources may not have a column {OBJECT}")
    id, manifest = snapshot_manifest(sources, semantics, date)
    spark = some.sparkSession
    manifest = stash(manifest, "manifest")
    known = _table(spark, f"{store}/objects_index", OBJECTS).select("digest").distinct()
    # The first source that holds an object writes it.
    each = manifest.groupBy("digest").agg(F.min("source").alias("source"), F.first("date").alias(OBJECT + "_date"), F.first("rows").alias("rows"), F.first("bytes").alias("bytes"))
    fresh = stash(each.join(known, "digest", "left_anti"), "fresh")
    added = fresh.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    total = manifest.agg(F.count("*").alias("n"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in some.schema.fields]).json()
    hit = not _table(spark, f"{store}/snapshots", SNAPSHOTS).where(F.col("snapshot_id") == id).limit(1).isEmpty()
    if added.n:
        for name, df in sources.items():
            new = fresh.where(F.col("source") == name).select(F.col("digest").alias(OBJECT), OBJECT + "_date")
            rows = df.join(new, F.col(date).cast("string") == F.col(OBJECT + "_date")).drop(OBJECT + "_date")
            # Rows are dealt by their content, so that a repeated task deals them alike.
            dealt = F.pmod(F.xxhash64(F.to_json(F.struct(*_plain(df)))), F.lit(salt))
            rows.repartition(OBJECT, dealt).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(OBJECT).parquet(_objects(store, schema))
        _indexed(fresh, sources, date).write.mode("append").parquet(f"{store}/objects_index")
    if not hit:
        # By snapshot and overwritten, so that a run which ended here leaves no doubles.
        manifest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(f"{store}/manifests")
        spark.createDataFrame([(id, schema, date)], SNAPSHOTS).coalesce(1).write.mode("append").parquet(f"{store}/snapshots")
    return {"snapshot_id": id, "rows": total.rows, "objects": total.n, "added_bytes": added.bytes, "reused_bytes": total.bytes - added.bytes, "cache_hit": hit}


def _indexed(fresh: DataFrame, sources: dict[str, DataFrame], date: str) -> DataFrame:
    """Entries of new objects: the symbols of one that has few, else their ends; nothing
    of what has no symbols."""
    held = None
    for name, df in sources.items():
        if SYMBOL in df.columns:
            new = fresh.where(F.col("source") == name).select("digest", OBJECT + "_date")
            one = df.select(F.col(date).cast("string").alias(OBJECT + "_date"), F.col(SYMBOL).cast("string").alias(SYMBOL)).join(new, OBJECT + "_date").select("digest", SYMBOL)
            held = one if held is None else held.unionByName(one)
    entries = fresh.select("digest", "rows", "bytes")
    if held is None:
        return entries.select("*", F.lit(None).cast("array<string>").alias("symbols"), F.lit(None).cast("string").alias("low"), F.lit(None).cast("string").alias("high"))
    each = held.where(F.col(SYMBOL).isNotNull()).distinct()
    first = each.withColumn("n", F.row_number().over(Window.partitionBy("digest").orderBy(SYMBOL))).where(F.col("n") <= LISTED + 1)
    lists = first.groupBy("digest").agg(F.sort_array(F.collect_list(SYMBOL)).alias("symbols"))
    ends = each.groupBy("digest").agg(F.min(SYMBOL).alias("low"), F.max(SYMBOL).alias("high"))
    return entries.join(lists, "digest", "left").join(ends, "digest", "left").withColumn("symbols", F.when(F.size("symbols") <= LISTED, F.col("symbols"))).select("digest", "rows", "bytes", "symbols", "low", "high")


def _head(spark: SparkSession, store: str, id: str) -> tuple[DataFrame, T.StructType, str, str]:
    """Manifest of a snapshot, the schema that it was frozen with, where its objects lie, and its date column."""
    head = _table(spark, f"{store}/snapshots", SNAPSHOTS).where(F.col("snapshot_id") == id).first()
    if head is None:
        raise ValueError(f"no snapshot {id}")
    manifest = _table(spark, f"{store}/manifests", MANIFEST).where(F.col("snapshot_id") == id)
    return manifest, T.StructType.fromJson(json.loads(head.schema)), _objects(store, head.schema), head.date_column


def _rows(spark: SparkSession, schema: T.StructType, path: str, digests: list[str] | None = None) -> DataFrame:
    """Stored rows with the object that each is of: of all objects, or of those named alone."""
    full = T.StructType([*schema.fields, T.StructField(OBJECT, T.StringType())])
    if digests is None:
        return _table(spark, path, full)
    return spark.read.schema(full).option("basePath", path).parquet(*[f"{path}/{OBJECT}={d}" for d in digests]) if digests else spark.createDataFrame([], full)


def scan_plan(spark: SparkSession, store: str, id: str, dates: list[str] | None = None, symbols: list[str] | None = None, source: str | None = None) -> DataFrame:
    """The manifest's rows with ``opened``: whether an object may hold rows of these dates
    and symbols, as the manifest and the objects' entries tell."""
    manifest = _head(spark, store, id)[0]
    wanted = manifest if source is None else manifest.where(F.col("source") == source)
    entries = _table(spark, f"{store}/objects_index", OBJECTS).groupBy("digest").agg(*[F.first(c).alias(c) for c in ("symbols", "low", "high")])
    hit = F.lit(True) if dates is None else F.col("date").isin(dates) if dates else F.lit(False)
    if symbols is not None:
        among = F.array(*map(F.lit, symbols)).cast("array<string>")
        between = F.exists(among, lambda s: (s >= F.col("low")) & (s <= F.col("high")))
        # An object without an entry, or without symbols in it, may hold anything.
        hit &= F.coalesce(F.when(F.col("symbols").isNotNull(), F.arrays_overlap("symbols", among)).otherwise(between), F.lit(True)) if symbols else F.lit(False)
    return wanted.join(entries, "digest", "left").select("source", "date", "digest", "rows", "bytes", hit.alias("opened"))


def scan_summary(plan: DataFrame, columns: int, all_columns: int) -> DataFrame:
    """Objects and bytes that a plan opens, of all, and columns."""
    each = plan.groupBy("digest").agg(F.bool_or("opened").alias("opened"), F.first("bytes").alias("bytes"))
    return each.agg(
        F.count_if("opened").alias("files_selected"), F.count("*").alias("files_total"), F.coalesce(F.sum(F.when(F.col("opened"), F.col("bytes"))), F.lit(0)).alias("bytes_selected"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes_total"),
        F.lit(columns).alias("columns_selected"), F.lit(all_columns).alias("columns_total"),
    )


def read_snapshot(spark: SparkSession, store: str, id: str, source: str | None = None, verified: bool = False, columns: list[str] | None = None, dates: list[str] | None = None, symbols: list[str] | None = None) -> DataFrame:
    """The rows of a snapshot, or of one of its sources, as they were frozen: an object
    that several sources hold comes once for each.

    With ``dates`` or ``symbols`` the manifest names the objects to open, as many as the
    dates at most, and no other is listed or read; both conditions and ``columns`` reach the scan of
    those (see ``selected`` for what is an error).  With ``verified`` changed, missing or doubled
    content of what is opened is an error.  An unknown id is one always; a snapshot
    without rows is an empty table of its schema.
    """
    manifest, schema, path, date = _head(spark, store, id)
    wanted = manifest if source is None else manifest.where(F.col("source") == source)
    chosen, names = None, schema.names if columns is None else columns
    if dates is not None or symbols is not None:
        selected(spark.createDataFrame([], schema), names, dates, symbols, date, SYMBOL)  # the caller's errors come first
        wanted = scan_plan(spark, store, id, dates, symbols, source).where("opened")
    if dates is not None:
        chosen = sorted(r.digest for r in wanted.select("digest").distinct().collect())
    if verified and (bad := stored_errors(spark, store, id, chosen).limit(5).collect()):
        raise ValueError(f"content differs from the manifest: {[r.asDict() for r in bad]}")
    rows = _rows(spark, schema, path, chosen).join(wanted.select(F.col("digest").alias(OBJECT)), OBJECT).select(*schema.names)
    return rows if columns is None and dates is None and symbols is None else selected(rows, names, dates, symbols, date, SYMBOL)


def stored_errors(spark: SparkSession, store: str, id: str, digests: list[str] | None = None) -> DataFrame:
    """date, digest and what was found (null: nothing) of objects of a snapshot, or of
    those named, whose stored rows are not those of the manifest; empty when all is sound."""
    manifest, schema, path, date = _head(spark, store, id)
    stated = manifest.select(F.col("digest").alias(OBJECT), "date").distinct()
    stated = stated if digests is None else stated.where(F.col(OBJECT).isin(digests)) if digests else stated.limit(0)
    have = date_digests(_rows(spark, schema, path).join(stated.select(OBJECT), OBJECT, "left_semi"), date, OBJECT)
    joined = stated.join(have.select(OBJECT, F.col("digest").alias("found")), OBJECT, "left")
    return joined.where(~F.col(OBJECT).eqNullSafe(F.col("found"))).select("date", F.col(OBJECT).alias("digest"), "found")


def verify(df: DataFrame, manifest: DataFrame, date: str = "date") -> DataFrame:
    """Dates whose rows are not those of the manifest; empty when all is sound."""
    have = date_digests(df, date).select("date", F.col("digest").alias("found"), F.col("rows").alias("found_rows"))
    joined = manifest.select("date", "digest", "rows").join(have, "date", "full_outer")
    return joined.where(~F.col("digest").eqNullSafe(F.col("found")) | ~F.col("rows").eqNullSafe(F.col("found_rows")))


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """What became of each date between two manifests."""
    a, b = old.select("date", F.col("digest").alias("before")), new.select("date", F.col("digest").alias("after"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") == F.col("after"), "reused").otherwise("changed")
    return a.join(b, "date", "full_outer").select("date", change.alias("change"))
