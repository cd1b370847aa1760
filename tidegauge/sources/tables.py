"""Readers and writers of the tables that jobs start from and leave."""

from __future__ import annotations

import hashlib
import re
import uuid

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.clocks import strict_date
from tidegauge.functions.symbols import normalize_symbol


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all machines share, which the session names in
    spark.checkpoint.dir.  Only where a session on a single machine names none, one
    beside the warehouse serves."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return f"{root or spark.conf.get('spark.sql.warehouse.dir') + '/_checkpoints'}/tidegauge/{label}-{uuid.uuid4().hex}"


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the folder that all machines share and read it again: its
    lineage ends there."""
    path = fresh_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_returns_csv(spark: SparkSession, path: str, date: str = "date", value: str = "net_return", series: str | None = None) -> DataFrame:
    """Daily returns as texts, under the names that the operators use; a file without
    a series column is one series named after its path."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8")
    name = F.col(f"`{series}`") if series else F.input_file_name()
    return raw.select(name.alias("series"), F.col(f"`{date}`").alias("date"), F.col(f"`{value}`").alias("net_return"))


LABELS = "label_id string, status string, value string, available_at string, training_role string"
FITS = "fit_id string, decision_at string, training_label_ids array<string>, fitted_rows long, model struct<path: string, sha256: string>"
ACCOUNT = "observed_at string, cash string, position_value string, equity string"


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]
    raw = spark.read.csv(path, header=True)
    # The first name may carry a byte-order mark.
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    return raw.select(*[F.col(n).cast("string").alias(n) for n in names])


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, LABELS)


def read_account(spark: SparkSession, path: str) -> DataFrame:
    """The ledger with ``seq``, the order of its lines within the file."""
    return _csv(spark, path, ACCOUNT).withColumn("seq", F.monotonically_increasing_id())


def read_fits(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank ones are skipped."""
    return spark.read.schema(FITS).json(path).where("fit_id is not null or decision_at is not null")


def read_membership(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Dated snapshots under dt=*/cs_norm.parquet: (snapshot_date, symbol) and one row
    (snapshot_date, path, sha256) for each snapshot, also for those without a symbol.

    Only the symbol column is read.  Fails if there is no snapshot, or a date is not
    a date or comes twice.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "cs_norm.parquet").option("recursiveFileLookup", "true").load(root).select("path")
    headers = files.withColumn("dt", F.regexp_extract("path", "/dt=([^/]*)/", 1)).withColumn("snapshot_date", strict_date("dt"))
    found = headers.agg(F.count("*").alias("n"), F.count("snapshot_date").alias("dated"), F.countDistinct("snapshot_date").alias("dates")).first()
    if not found.n:
        raise FileNotFoundError(f"no membership snapshot under {root}")
    if found.dated < found.n or found.dates < found.n:
        raise ValueError("snapshot dates must be dates, each once")
    rows = spark.read.option("pathGlobFilter", "cs_norm.parquet").option("recursiveFileLookup", "true").parquet(root).select("symbol", strict_date(F.regexp_extract("_metadata.file_path", "/dt=([^/]*)/", 1)).alias("snapshot_date"))
    members = rows.select("snapshot_date", normalize_symbol(rows, "symbol").alias("symbol")).where("symbol <> ''").distinct()
    return members, headers.join(file_digests(spark, root, "cs_norm.parquet"), "path", "left").select("snapshot_date", "path", "sha256")


def _streamed(batches):
    """path, bytes and sha256 of files that are too large for a row, read in pieces."""
    for b in batches:
        hashes = []
        for path in b.column("path").to_pylist():
            system, name = pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
            digest = hashlib.sha256()
            with system.open_input_stream(name) as file:
                while piece := file.read(PIECE):
                    digest.update(piece)
            hashes.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("path"), b.column("bytes"), pa.array(hashes, pa.string())], names=["path", "bytes", "sha256"])


#: Bytes of a file that is hashed as a row, and of a piece of a larger one.
WHOLE, PIECE = 64 << 20, 4 << 20


def file_digests(spark: SparkSession, path: str, pattern: str = "*", whole: int = WHOLE) -> DataFrame:
    """path, bytes and sha256 of each file.

    A file of up to ``whole`` bytes is a row of Spark's reader.  A larger one is read by its own
    task in pieces, over a file system that Arrow knows; one in a store that only Spark
    reads is an error, not a missing hash.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    small = files.where(F.col("length") <= whole).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > whole).select("path", F.col("length").alias("bytes"))
    # Each large file is a task of its own as far as there are tasks.
    dealt = large.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return small.unionByName(dealt.mapInArrow(_streamed, "path string, bytes long, sha256 string"))


def selected(df: DataFrame, columns: list[str], dates: list[str] | None = None, symbols: list[str] | None = None, date: str = "date", symbol: str = "symbol") -> DataFrame:
    """A projected and filtered read of a table partitioned by date.

    Filters are conditions on partition and data columns, so they reach the scan; an
    empty list selects nothing.  Unknown, repeated or no columns, dates that are not
    strict and symbols that are not six digits are errors.
    """
    if not columns or len(set(columns)) < len(columns) or set(columns) - set(df.columns):
        raise ValueError("columns must be known, named once, and at least one")
    import datetime

    for d in dates or []:
        if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", d):
            raise ValueError(f"not an ISO date: {d}")
        datetime.date.fromisoformat(d)
    if bad := [s for s in symbols or [] if not re.fullmatch(r"\d{6}", s)]:
        raise ValueError(f"not six digits: {bad[:10]}")

    def condition(column: str, values: list[str] | None) -> Column:
        return F.lit(True) if values is None else F.col(column).isin(values) if values else F.lit(False)

    return df.where(condition(date, dates) & condition(symbol, symbols)).select(*columns)


def scan_statistics(manifest: DataFrame, dates: list[str] | None, columns: int, all_columns: int) -> DataFrame:
    """Files and bytes that a selection opens, of all in the manifest (date, bytes)."""
    hit = F.lit(True) if dates is None else F.col("date").cast("string").isin(dates) if dates else F.lit(False)
    return manifest.agg(
        F.count_if(hit).alias("files_selected"), F.count("*").alias("files_total"), F.coalesce(F.sum(F.when(hit, F.col("bytes"))), F.lit(0)).alias("bytes_selected"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes_total"),
        F.lit(columns).alias("columns_selected"), F.lit(all_columns).alias("columns_total"),
    )
