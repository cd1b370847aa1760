"""What several operators of this subpackage need."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here: ASCII space and \t \n \v \f \r.
BLANKS = r"[\x20\x09-\x0D]+"


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that all machines share, as the session names it.

    Only where a session on a single machine names none is a folder beside the warehouse used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def recorded(made: list[str]) -> Iterator[None]:
    """Adds the paths that ``stash`` writes meanwhile to ``made``."""
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)


def drop(spark: SparkSession, made: list[str]) -> None:
    """Deletes tables that ``stash`` wrote, once nothing reads them any more."""
    while made:
        path = spark._jvm.org.apache.hadoop.fs.Path(made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    This cuts the lineage: a lost executor costs the tasks it ran, and what
    follows reads committed files.  Parquet is smaller than an RDD checkpoint.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/tidegauge/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (made := _made.get()) is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of finished queries once the driver's garbage is
    collected, which may be long after; a job of many steps asks for that in between."""
    spark._jvm.System.gc()


def slices(batch: pa.RecordBatch, column: str, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``size`` bytes of text each, and one row at least."""
    end = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = end[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(end, before + size, "right")))
        yield batch.slice(start, stop - start)
        start = stop


#: What this Python worker holds for later tasks, and for which operator.
_held: dict[tuple, object] = {}
_holder: list[str] = []


def kept_here(make: Callable, *args):
    """``make(*args)``, which this Python worker keeps until another operator's task begins."""
    if (make, args) not in _held:
        _held[make, args] = make(*args)
    return _held[make, args]


def _begin(operator: str) -> None:
    if _holder != [operator]:
        _held.clear()
        _trim()
        _holder[:] = [operator]


def _trim() -> None:
    """Freed memory goes back to the system; elsewhere than in glibc that is left to the allocator."""
    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give(0)


def frugal(work: Callable, trim: bool = True) -> Callable:
    """``work`` on the batches of a task, for Python workers that go on to serve others.

    Spark keeps workers for the tasks of all later stages, so what one of them holds or
    has freed but not returned would take room from every stage after it.  Without ``trim``
    that waits for the next operator's task, so that tasks of one need not ask for it again.
    """
    operator = work.__module__

    @wraps(work)
    def run(batches):
        _begin(operator)
        try:
            yield from work(batches)
        finally:
            if trim:
                _trim()

    return run


@contextmanager
def small_batches(spark: SparkSession, size: int = 1 << 20) -> Iterator[None]:
    """What is written meanwhile hands rows to Python in batches of about ``size`` bytes.

    By default they may have 64 MB, and an executor and its Python workers keep the room
    that the largest one took.  A limit that the session names is left alone, and
    afterwards none is named, as before.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is not None:
        yield
        return
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.unset(name)


def text_of(column: str | Column) -> Column:
    """A text in which null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, mod ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
