"""A corpus from raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and its
result is written before the next stage is called.  So the next one first deletes the
tables that earlier stages wrote for themselves.  Texts reach Python in small batches, in what
a stage writes itself.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm import exact_dedup, mixing, packing, simhash, toxicity
from tidegauge.llm.queries import vocabulary
from tidegauge.llm.shared import drop, recorded, small_batches, stash

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables that finished stages of this thread's run wrote for themselves.
_left: ContextVar[list[str]] = ContextVar("left")


def stage(work: Stage) -> Stage:
    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _left.get(None)
        if left is None:
            _left.set(left := [])
        drop(spark, left)
        with recorded(left), small_batches(spark):
            return work(spark, docs, sf_dir)

    return run_stage


@stage
def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    with recorded(made := []):
        model = toxicity.fit(toxicity.learnable(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    drop(spark, made)  # the model has all that scores need
    return stash(toxicity.score(docs, model, carry=True).where("predicted = 0").select("row.*"), "clean")


@stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays."""
    return exact_dedup.drop_copies(docs)


@stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word similarity of 0.8 or more one stays."""
    return simhash.keep_one(docs, words=5, similarity=True)


@stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are read as often and in the order that the mix takes them."""
    return mixing.mixed_rows(docs)


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences; its workers stand beside executors that earlier stages filled."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), remembered=1 << 16)


STAGES = [("toxicity", toxic), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixed), ("packing", packed)]

#: SQL can't express the model, fingerprints and tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage.  Of the tables written on the way only theirs stays."""
    docs, before, mine = spark.read.parquet(f"{sf_dir}/documents.parquet"), [], _left.set([])
    try:
        for name, work in STAGES:
            with recorded(made := []):
                docs = stash(work(spark, docs, sf_dir), f"stage-{name}")
            drop(spark, before)
            before = made
        drop(spark, _left.get())
    finally:
        _left.reset(mine)
    return docs
