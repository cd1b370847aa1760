"""Token counts, packing and mixing."""

import cProfile
import random
import time
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidegauge.llm import mixing, packing, token_counts
from tidegauge.llm.bpe import spans

TEXTS = ["", None, " ", "it's 'll we've", "a" * 3000, "\n\n x  y\t\t", "<|endoftext|>a<|endoftext|>", "\x1c a\x85b\xa0c", "日本語 テスト", "é İSTANBUL ΣΑΣ 👩‍👩‍👧", "x" + " " * 9 + "y", "12345 6,7"]


def awkward():
    r = random.Random(4)
    parts = ["a", "b", " ", "  ", "\n", "é", "1", "'s", "́", "漢", "😀", ".", "<|endoftext|>", "the ", "ing", "Σ", "İ"]
    return TEXTS + ["".join(r.choices(parts, k=r.randint(0, 40))) for _ in range(400)] + ["word " * 9000, "pre " + "fix, " * 700]


def docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({"length": F.lit("x"), "pid": F.lit(1), "row": F.lit(2), "size": F.lit(3)})


def test_counts_are_the_library_s(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, texts = Tokenizer.from_file(path), awkward()
    got = {r.doc_id: r for r in token_counts.count_tokens(docs(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 1024), repr(t)[:80]
    assert token_counts.count_tokens(docs(spark, texts).limit(0), path).count() == 0


def test_spans_lose_nothing():
    text = "ab cd  ef\n" * 50 + "x" * 100
    assert "".join(spans(text, 16)) == text and len(list(spans(text, 16))) > 5 and list(spans("")) == [""]


def test_packing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, texts = Tokenizer.from_file(path), awkward() + ["the same"] * 300
    got = packing.pack(docs(spark, texts), path, capacity=256).toPandas()
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        own = got[got.doc_id == i].sort_values("piece")
        assert own["start"].tolist() == list(range(0, len(ids), 256)) and own["length"].sum() == len(ids) and (own["length"][:-1] == 256).all()
        assert own["ids_crc32"].tolist() == [zlib.crc32(np.array(ids[s : s + 256], "<u4").tobytes()) for s in own["start"]]
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["length"].sum() <= 256 and s["offset"].tolist() == [0, *s["length"].cumsum()[:-1]]
    bound = -(-got["length"].sum() // 256)
    assert bound <= got["sequence_id"].nunique() <= bound + 1
    assert packing.pack(docs(spark, texts).limit(0), path).count() == 0


def fewest(items, capacity):
    best = [len(items)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + items[k] <= capacity:
                bins[b] += items[k]
                place(k + 1, bins)
                bins[b] -= items[k]
        bins.append(items[k])
        place(k + 1, bins)
        bins.pop()

    place(0, [])
    return best[0]


def test_reduction_is_safe():
    """What the reduction fixes never costs a sequence."""
    r = random.Random(6)
    for _ in range(150):
        items = sorted((r.randint(1, 20) for _ in range(r.randint(1, 9))), reverse=True)
        count = np.bincount(items, minlength=21)
        fixed = packing.reduce(count, 20)
        left = [w for w in range(20, 0, -1) for _ in range(count[w])]
        assert sum(t for t, _ in fixed) + (fewest(left, 20) if left else 0) == fewest(items, 20), items


def test_plan_covers_all():
    r = np.random.default_rng(7)
    for n in (0, 1, 40, 3000):
        count = np.bincount(np.minimum(r.lognormal(4, 1, n).astype(int) + 1, 512), minlength=513)
        plan = packing.plan(count, 512)
        total = np.zeros(513, int)
        for times, shape in plan:
            assert sum(w * k for w, k in shape.items()) <= 512
            for w, k in shape.items():
                total[w] += times * k
        assert (total == count).all() and len(plan) <= 4 * 512


def mix_docs(spark):
    r = random.Random(8)
    rows = [(i, " ".join(["w"] * r.randint(0, 30)), r.choice(["a", "b", "b", "b", "c", None, "z"])) for i in range(400)] + [(5, "twice", "a"), (5, "twice", "a"), (None, "no id", "c"), (401, None, "b"), (402, None, "empty")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("mine"))


def test_mix(spark):
    got = mixing.assign(mix_docs(spark)).toPandas()
    total = got["size"].sum()
    sizes = got.groupby("doc_id").size()
    assert len(got) == 405 and sizes.max() == 3
    by = mixing.assign(mix_docs(spark), carry=True).select("row.source", "size", "source_size", "target", "taken", "uses").toPandas()
    by["source"] = by["source"].fillna("~")
    weights = dict(zip(sorted(by["source"].unique(), key=lambda s: (s == "~", s)), [3, 1, 2] * 5))
    own = by.groupby("source")["size"].sum()
    want, fixed = {}, set()
    while True:
        left = 1.5 * total - sum(2 * own[s] for s in fixed)
        level = left / sum(w for s, w in weights.items() if s not in fixed)
        over = {s for s, w in weights.items() if s not in fixed and level * w > 2 * own[s]}
        if not over:
            break
        fixed |= over
    for s, w in weights.items():
        want[s] = 2 * own[s] if s in fixed else level * w
    for s, rows in by.groupby("source"):
        assert rows["source_size"].iloc[0] == own[s] and rows["target"].iloc[0] == pytest.approx(want[s]) and abs(rows["taken"].sum() - want[s]) <= 1
    assert (by["taken"] <= 2 * by["size"]).all()
    assert all(sum(u.words for u in r.uses) == r.taken and all(0 <= u.position <= 1 for u in r.uses) for r in by.itertuples())
    again = mixing.assign(mix_docs(spark).repartition(7)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(str, got[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
    assert mixing.assign(mix_docs(spark).limit(0)).count() == 0


def test_positions_follow_the_schedule(spark):
    grid = spark.range(0, 1000).select((F.col("id") / 1000).alias("part"))
    for k, knots in enumerate(mixing.SCHEDULES):
        t = np.array([r[0] for r in grid.select(mixing.position(F.col("part"), F.lit(k))).collect()])
        times = np.linspace(0, 1, 100001)
        area = np.cumsum(np.interp(times, np.linspace(0, 1, len(knots)), knots))
        want = np.interp(np.arange(1000) / 1000, area / area[-1], times)
        assert np.abs(t - want).max() < 1e-3 and (np.diff(t) >= 0).all()


def test_stream_of_the_mix(spark):
    df = mix_docs(spark)
    rows = mixing.mixed_rows(df)
    assert rows.dtypes == df.dtypes
    words = sum(len((r.text or "").split()) for r in rows.collect())
    assert words == mixing.assign(df).agg(F.sum("taken")).first()[0]
    at = [r.position for r in mixing.training_order(mixing.assign(df)).collect()]
    assert at == sorted(at)


def test_long_words(spark):
    """A megabyte without a space, rows that repeat and null ids."""
    r, began = random.Random(9), time.monotonic()
    long = "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    some = spark.createDataFrame([(1, long), (1, long[:700]), (1, long[:700]), (None, "twice twice"), (None, "ab" * 3000)], "doc_id long, text string").coalesce(1)
    for name, run in (("byte_bpe_50k.json", token_counts.count_tokens), ("word_bpe_49k.json", packing.pack)):
        path = public_tokenizers.path(name)
        library, got = Tokenizer.from_file(path), run(some, path).toPandas()
        want = [len(library.encode(t, add_special_tokens=False).ids) for t in (long, long[:700], long[:700], "twice twice", "ab" * 3000)]
        if run is packing.pack:
            assert got["length"].sum() == sum(want) + 5 and got["doc_id"].isna().sum() == 1 + -(-(want[4] + 1) // 2048)
        else:
            assert sorted(got["n_tokens"]) == sorted(want) and got["doc_id"].isna().sum() == 2
    assert time.monotonic() - began < 60


def test_words_by_hash():
    r = random.Random(10)
    words = ["".join(r.choices("abc", k=r.randint(1, 6))).encode() for _ in range(5000)]
    lines = b" ".join(words)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    start = np.append(0, end[:-1] + 1)
    first, kind = packing.grouped(np.frombuffer(lines, np.uint8), start, end)
    assert [words[i] for i in first[kind]] == words and len(first) == len(set(words))


@pytest.fixture
def cut(monkeypatch):
    """Pieces of texts as a worker cuts them, here in this process."""
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))

    def run(texts, capacity=64, remembered=packing.REMEMBERED):
        batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
        batches = [batch.slice(at, 150) for at in range(0, len(texts), 150)]
        return [tuple(r.values()) for b in packing.cutter(public_tokenizers.path("word_bpe_49k.json"), capacity, remembered)(iter(batches)) for r in b.select(range(5)).to_pylist()]

    return run


def test_pieces_are_the_library_s(cut, monkeypatch):
    """Every character of one or two bytes in and between words, parts about as long as
    two numbers hold, short forms, and blocks that end inside texts."""
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    letters = [chr(c) for c in range(0x800)]
    texts = [t or "" for t in awkward()] + letters + [f"X{c}{c} 'S{c}'RE'{c}é, 1{c}" for c in letters]
    texts += ["".join(c * n for n in range(5, 20) for c in (a, b)) for a, b in ("a.", "éb", "a'", "É1", "a ", "' ")]
    texts += ["it''s 'TIS we'LLd 'd'm're", "a\0 a\0\0 \0", "x<|endoftext|>y <|ENDOFTEXT|>", "sixteen letters: abcdefghijklmnop abcdefghijklmnopq"]
    want = [[*e.ids, 0] for e in library.encode_batch(texts, add_special_tokens=False)]
    pieces = [(i, s // 64, s, len(x[s : s + 64]), zlib.crc32(np.array(x[s : s + 64], "<u4").tobytes())) for i, x in enumerate(want) for s in range(0, len(x), 64)]
    assert cut(texts) == pieces
    monkeypatch.setattr(packing, "BLOCK", 50)
    assert cut(texts) == pieces == cut(texts, remembered=40)


def test_new_words_cost_no_calls(cut):
    """Words that a worker meets for the first time are found, told apart and merged on arrays:
    no Python call for each of them, which was most of the time of packing."""
    r = random.Random(12)
    words = {"".join(r.choices("etaoinshrdluéü", k=r.randint(4, 12))) for _ in range(60_000)}
    cut(["one"])
    with cProfile.Profile() as profile:
        (piece, *_) = cut([" ".join(words)], capacity=1 << 20)
    assert piece[3] > len(words) > 50_000
    assert sum(x.callcount for x in profile.getstats()) < len(words) // 4
