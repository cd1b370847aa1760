"""The pipeline's stages against brute force."""

import gc
import random
import re
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tidegauge.llm import packing, shared, toxicity
from tidegauge.llm.queries import vocabulary


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    r, at = random.Random(12), tmp_path_factory.mktemp("data")
    words = [f"w{int(r.paretovariate(0.8)) % 900}" for _ in range(4000)]
    rows = [(i, " ".join(r.choices(words, k=r.randint(20, 200)) + (["vile", "scum", "vile"] if i % 5 == 0 else [])), "en", f"s{i % 4}", i) for i in range(300)]
    rows += [(400 + i, rows[i][1].replace(" ", "\t\n", 3), "en", "s0", i) for i in range(1, 80)]
    rows += [(500 + i, rows[i][1] + " w1", "en", "s1", i) for i in range(1, 80)]
    rows += [(600, None, None, None, None), (601, "", "en", None, 0), (1, rows[1][1], "en", "s1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages(spark, data, tmp_path):
    docs, kept = spark.read.parquet(f"{data}/documents.parquet"), {}
    for name, work in corpus_pipeline.STAGES:
        before = docs
        work(spark, docs, data).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.dtypes == before.dtypes
    toxic = {r.doc_id for r in spark.read.parquet(f"{data}/documents.parquet").collect() if {"vile", "scum"} & set((r.text or "").split())}
    assert not toxic & {r.doc_id for r in kept["toxicity"]} and len(kept["toxicity"]) >= 461 - len(toxic) - 3
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    least = {}
    for r in kept["toxicity"]:
        least[norm(r.text)] = min(r.doc_id, least.get(norm(r.text), r.doc_id))
    assert sorted(r.doc_id for r in kept["exact_dedup"]) == sorted(least.values())
    rows = sorted(kept["exact_dedup"], key=lambda r: r.doc_id)
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    sets = [grams((r.text or "").lower().split()) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    assert sorted(r.doc_id for r in kept["near_dedup"]) == sorted(rows[g].doc_id for g in set(group))
    assert len(kept["near_dedup"]) < len(kept["exact_dedup"])
    size = lambda rows: sum(len((r.text or "").split()) for r in rows)
    assert abs(size(kept["mixing"]) - 1.5 * size(kept["near_dedup"])) <= 5
    assert {r.doc_id for r in kept["mixing"]} <= {r.doc_id for r in kept["near_dedup"]}
    assert sorted(r.doc_id for r in kept["packing"] if r.piece == 0) == sorted(r.doc_id for r in kept["mixing"])
    assert len({(r.row_id, r.piece) for r in kept["packing"]}) == len(kept["packing"])
    fill = {}
    for r in kept["packing"]:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 2048 and len(fill) == -(-sum(fill.values()) // 2048)


def test_run_and_registry(spark, data):
    import os

    left = lambda: {d for d in os.listdir(f"{shared.checkpoint_root(spark)}/tidegauge")}
    before = left()
    assert corpus_pipeline.run(spark, data).count() > 100
    assert [d.split("-")[1] for d in left() - before] == ["packing"]
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert {"pipeline", *(f"op{n}_" for n in range(1, 11))} <= {re.sub(r"(?<=\d_).*", "", q) if q.startswith("op") else q for q in queries} and set(sql) <= set(queries)


def test_tables_go(spark):
    made = []
    with shared.recorded(made):
        shared.stash(spark.range(3).withColumn("x", F.lit(1)), "test")
    path = made[0]
    assert spark.read.parquet(path).count() == 3
    shared.drop(spark, made)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_stages_batches(spark, tmp_path):
    """Stages hand texts to Python in small batches and leave the session as it was."""
    name, sizes = "spark.sql.execution.arrow.maxBytesPerBatch", []
    docs = spark.range(0, 300, 1, 1).selectExpr("id AS doc_id", "repeat('some words ', 8000) AS text")

    def measured(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    @corpus_pipeline.stage
    def work(spark, docs, sf_dir):
        sizes.extend(r.n for r in shared.stash(docs.mapInArrow(measured, "n long"), "test").collect())
        if sf_dir == "fails":
            raise ValueError(sf_dir)
        return docs

    work(spark, docs, "")
    assert sum(sizes) > 25 << 20 and max(sizes) < 6 << 20
    assert spark.conf.get(name, None) is None
    with pytest.raises(ValueError, match="fails"):
        work(spark, docs, "fails")
    assert spark.conf.get(name, None) is None
    spark.conf.set(name, 1 << 20)
    try:
        sizes.clear()
        work(spark, docs, "")
        assert max(sizes) < 2 << 20 and spark.conf.get(name) == str(1 << 20)
    finally:
        spark.conf.unset(name)


def test_stages_batches_of_a_megabyte(spark):
    docs = spark.range(0, 100, 1, 1).selectExpr("repeat('some words ', 8000) AS text")

    def measured(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    @corpus_pipeline.stage
    def work(spark, docs, sf_dir):
        return shared.stash(docs.mapInArrow(measured, "n long"), "test")

    sizes = [r.n for r in work(spark, docs, "").collect()]
    assert sum(sizes) > 8 << 20 and max(sizes) < 3 << 19


def test_workers_let_go(monkeypatch):
    """What packing holds for its next task in a Python worker goes when another operator's task begins there."""
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["some words", "other words"], "fold": [0, 1], "toxic": [0, 1]})

    def alive():
        gc.collect()
        return [id(x) for x in gc.get_objects() if type(x) is packing.WordIds]

    for _ in range(2):
        (found,) = packing.cutter(vocabulary("word_bpe_49k.json"), 2048)([batch])
        assert found.num_rows == 2
        held = alive()
        assert len(held) == 1
    list(packing.cutter(vocabulary("word_bpe_49k.json"), 2048)([batch]))
    assert alive() == held
    assert sum(b.num_rows for b in toxicity.count_tokens([batch])) == 4
    assert alive() == []


def test_remembered_words(spark):
    """Few words are remembered, and the pieces are the same."""
    docs = spark.range(0, 60, 1, 2).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 40), k -> concat('w', hex(k * 37 + id * 11)))) AS text")
    few, all_ = (sorted(map(tuple, packing.pieces(docs, vocabulary("word_bpe_49k.json"), remembered=n).collect())) for n in (10, 1 << 18))
    assert few == all_ and len(few) == 60


def test_empty_and_clashing(spark, data, tmp_path):
    """Stages take empty tables and columns named like their own."""
    names = ["row", "rid", "fp", "key", "size", "root", "members", "predicted", "edge", "position", "words", "length", "pid"]
    docs = spark.read.parquet(f"{data}/documents.parquet").withColumns({n: F.lit(n) for n in names})
    for k, some in enumerate((docs.limit(0), docs.where("doc_id < 40"))):
        for name, work in corpus_pipeline.STAGES:
            work(spark, some, data).write.parquet(path := str(tmp_path / f"{name}{k}"))
            before, some = some, spark.read.parquet(path)
            assert (some.count() > 0) == bool(k)
            if name != "packing":
                assert some.columns == before.columns
