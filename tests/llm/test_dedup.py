"""Exact, near and line deduplication against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidegauge.llm import exact_dedup, line_dedup, resemblance, shared, simhash
from tidegauge.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """Rows (id, text) with further columns, some named like the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], SCHEMA).withColumns({"kept": F.lit("mine"), "key": F.lit(1), "row": F.lit(None).cast("string"), "fp": F.lit(2.0), "sha": F.lit("z")})


def awkward():
    r = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(r.choices(words, k=r.randint(1, 30)))) for i in range(60)]
    rows += [(100 + i, "one \t\n text") for i in range(80)] + [(90, "one text"), (91, " one text"), (7, rows[7][1]), (7, rows[7][1]), (None, rows[8][1]), (None, None), (95, ""), (96, None), (97, " \t"), (98, " "), (99, "long " * 30000), (101, "long " * 30000), (102, "été\x0bà"), (103, "été à")]
    return rows


def test_exact_groups(spark):
    rows = awkward()
    got = exact_dedup.exact_groups(docs(spark, rows).repartition(5)).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    want = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i))
        want += [(i, ids[0], len(ids), n == 0, hashlib.sha256(text.encode()).hexdigest()) for n, i in enumerate(ids)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_drop_copies_keeps_columns(spark):
    df = docs(spark, awkward())
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns and kept.dtypes == df.dtypes
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in kept.collect()]
    assert len(norm) == len(set(norm)) == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in awkward()})
    assert exact_dedup.drop_copies(df.limit(0)).count() == 0 and exact_dedup.exact_groups(df.limit(0)).count() == 0


def brute_components(fps, ids, radius):
    u, inverse = np.unique(fps, return_inverse=True)
    root = list(range(len(u)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= radius):
            a, b = find(i), find(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    least = {}
    for k, i in zip(inverse, ids, strict=True):
        least[find(k)] = min(i, least.get(find(k), i))
    return {(i, least[find(k)]) for k, i in zip(inverse, ids, strict=True)}


def test_covering_masks():
    r = random.Random(1)
    masks = simhash.masks(4, list(range(64)))
    assert len(masks) == 31 and min((m & (1 << 64) - 1).bit_count() for m in masks) >= 32
    for _ in range(500):
        flips = sum(1 << b for b in r.sample(range(64), r.randint(0, 4)))
        assert any(m & flips == 0 for m in masks)
    for m in masks:
        free = [p for p in range(64) if not (m >> p) & 1]
        second = simhash.masks(4, free)
        for _ in range(50):
            flips = sum(1 << b for b in r.sample(free, 4))
            assert any(s & flips == 0 for s in second)


@pytest.mark.parametrize("at_once", [4096, 3])
def test_near_links(spark, at_once):
    r = random.Random(at_once)
    base = [r.getrandbits(64) for _ in range(20)]
    fps = base + [b ^ sum(1 << p for p in r.sample(range(64), r.randint(0, 6))) for b in base for _ in range(15)]
    u = sorted(set(fps))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    stars = components(simhash.near_links(spark.createDataFrame([(signed(x),) for x in u], "fp long"), 4, at_once))
    root = {r.node: r.root for r in stars.collect()}
    got = {(signed(x), root.get(signed(x), signed(x))) for x in u}
    want = brute_components(np.array(u, np.uint64), [signed(x) for x in u], 4)
    assert got == want


def test_near_duplicates(spark):
    import xxhash

    rows = [(i, t) for i, t in awkward() if i is not None]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    fps = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    want = brute_components(np.array(fps, np.uint64), [i for i, _ in rows], 4)
    assert {(g.doc_id, g.component_id) for g in got} == want
    assert {(g.doc_id, g.fingerprint) for g in got} == {(i, f"{f:016x}") for (i, _), f in zip(rows, fps, strict=True)}
    df = docs(spark, [*rows, (None, None)])
    kept = simhash.keep_one(df)
    assert kept.dtypes == df.dtypes and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want})
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_patience():
    assert line_dedup.patience([1, 2, 3, 4], [9, 2, 3, 8]) == [(1, 1), (2, 2)]
    assert line_dedup.patience([], [1]) == [] and line_dedup.patience([1, 1, 2], [1, 1, 2]) == [(0, 0), (1, 1), (2, 2)]
    r = random.Random(2)
    for _ in range(300):
        a, b = ([r.randrange(8) for _ in range(r.randrange(15))] for _ in range(2))
        found = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in found) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:]))
    assert line_dedup.increasing([(0, 3), (1, 1), (2, 2), (3, 0)]) == [(1, 1), (2, 2)]


def test_line_dedup(spark):
    line = lambda n: " ".join(f"{n}word{k}" for k in range(12))
    block = "\n".join([line("x"), "", line("y")])
    rows = [(1, f"{line('a')}\n{block}\n{line('b')}"), (2, f"{line('c')}\n{block.replace('xword0', ' xword0  ')}\n{line('d')}"), (3, f"short\n{line('e')}"), (4, f"short\n{line('f')}"), (5, None), (6, ""), (7, line("x")), (8, f"{line('y')}\n{line('x')}"), (None, line("a")), (9, line("z")), (9, line("z"))]
    df = docs(spark, rows)
    got = {r.row.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert got[1].deleted == [] and got[1].text == rows[0][1]
    assert got[2].text == f"{line('c')}\n{line('d')}" and got[2].deleted == [1, 2, 3]
    assert got[3].text == rows[2][1] and got[4].text == rows[3][1]  # too few words to go
    assert got[7].text == "" and got[None].text == "" and got[5].text == "" and got[6].text == "" and got[9].text == line("z")
    assert got[8].text == ""  # both lines go, each by the document that held it first
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_common_lines(spark):
    """A block whose lines all stand singly in many earlier documents."""
    lines = [f"line {k} of the block" for k in range(10)]
    rows = [(i, f"{lines[i % 10]}\nonly {i}") for i in range(700)] + [(1000 + i, "\n".join([f"before {i}", *lines, f"after {i}"])) for i in range(2)]
    got = {r.row.doc_id: r.deleted for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert got.pop(1001) == list(range(1, 11)) and not any(got.values())


def test_alignment_decides(monkeypatch):
    """A line that two blocks could take goes with the block that the alignment takes."""
    a, b, words = [1, 2, 5, 6, 2, 3], [5, 6, 1, 2, 3, 9], [6] * 6
    assert line_dedup.doomed(a, b, words, 10) == [0, 1, 3, 4]
    monkeypatch.setattr(line_dedup, "patience", lambda *_: [])
    assert line_dedup.doomed(a, b, words, 10) == [0, 1, 2, 3]


def stands(run, lines):
    return any(lines[i : i + len(run)] == run for i in range(len(lines) - len(run) + 1))


def test_alignment_of_random_pairs():
    """Only blocks of the earlier document go, and no run of enough words is left that stands in it."""
    r, moved = random.Random(11), 0
    for _ in range(4000):
        a, b = ([r.randrange(7) for _ in range(r.randrange(14))] for _ in range(2))
        size = [0, 1, 3, 4, 6, 10, 2]
        words = [size[x] for x in b]
        gone = line_dedup.doomed(a, b, words, 10)
        in_order = line_dedup.patience(a, b, words, 10)
        assert all(a[i] == b[j] for i, j in in_order) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(in_order, in_order[1:]))
        first = line_dedup.blocks(in_order, words, 10)
        moved += len(gone) > len(first)
        assert set(first) <= set(gone)
        for k in gone:
            assert any(i <= k < j and set(range(i, j)) <= set(gone) and sum(words[i:j]) >= 10 and stands(b[i:j], a) for i in range(k + 1) for j in range(k + 1, len(b) + 1))
        for i in range(len(b)):
            for j in range(i + 1, len(b) + 1):
                assert set(range(i, j)) & set(gone) or sum(words[i:j]) < 10 or not stands(b[i:j], a)
        # Without repeated lines anchors are a longest common part in order.
        x, y = r.sample(range(9), 7), r.sample(range(9), 7)
        best = [[0] * 8 for _ in range(8)]
        for i in range(7):
            for j in range(7):
                best[i + 1][j + 1] = best[i][j] + 1 if x[i] == y[j] else max(best[i][j + 1], best[i + 1][j])
        assert len(line_dedup.patience(x, y)) == best[7][7]
    assert moved > 50


def test_passage_standing_twice(spark, monkeypatch):
    assert line_dedup.doomed([1, 2, 3, 4], [5, 2, 3, 6, 2, 3, 7], [6] * 7, 10) == [1, 2, 4, 5]
    monkeypatch.setattr(line_dedup, "SHARE", 8)  # so that hashes and holders are spread
    r = random.Random(6)
    texts = [[r.randrange(9) for _ in range(r.randrange(14))] for _ in range(80)]
    words = [0, 1, 3, 4, 5, 6, 10, 2, 3]
    rows = [(i, "\n".join(" ".join([f"v{n}"] * words[n]) for n in t)) for i, t in enumerate(texts)]
    got = {x.row.doc_id: x.deleted for x in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    for n, b in enumerate(texts):
        size, partners = [words[x] for x in b], set()
        for i in range(len(b)):
            for j in range(i + 1, len(b) + 1):
                # A shortest run of enough words links to the earliest document that holds it.
                if size[i] and size[j - 1] and sum(size[i:j]) >= 10 and (sum(size[i : j - 1]) < 10 or sum(size[i + 1 : j]) < 10):
                    partners.add(next((k for k, a in enumerate(texts[:n]) if stands(b[i:j], a)), None))
        want = sorted({k for p in partners - {None} for k in line_dedup.doomed(texts[p], b, size, 10)})
        assert got[n] == want
        left = [k for k in range(len(b)) if k not in got[n]]
        for i in range(len(b)):
            for j in range(i + 1, len(b) + 1):
                assert not set(range(i, j)) <= set(left) or sum(size[i:j]) < 10 or not any(stands(b[i:j], a) for a in texts[:n])


def test_long_texts_with_many_copies(spark):
    """Twenty thousand lines of few words that repeat, and a passage of the earlier text many times over."""
    r = random.Random(7)
    common = [f"word{r.randrange(5)} and more" for _ in range(20_000)]
    passage = [f"a passage of ten words that stands many times {k}" for k in range(3)]
    rows = [(1, "\n".join([*passage, *common[:9000]])), (2, "\n".join(sum(([f"only {k}", *passage] for k in range(4000)), []))), (3, "\n".join(["else", *common[3000:]])), (4, None)]
    got = {x.row.doc_id: x for x in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert got[1].deleted == [] and got[4].deleted == [] and got[2].text.count("\n") == 3999 and "passage" not in got[2].text
    assert set(range(1, 6001)) <= set(got[3].deleted)


def test_resemblance(spark):
    r = random.Random(8)
    texts = [" ".join(r.choices([f"w{i}" for i in range(300)], k=r.choice([0, 1, 3, 5, 6, 8, 9, 12, 20, 60, 200]))) for _ in range(60)]
    for t in texts[:]:
        for _ in range(4):  # near copies from one changed word to a tenth of all
            w = t.split()
            for _ in range(r.randint(1, max(1, len(w) // 30))):
                k = r.randrange(len(w) + 1)
                w[k : k + r.randint(0, 1)] = [f"w{r.randrange(300)}"]
            texts.append(" ".join(w))
    rows = [*enumerate(texts), (None, texts[3].upper()), (990, None), (991, " \t")]

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets, group, apart = [grams(t) for _, t in rows], list(range(len(rows))), 0
    fps = simhash.fingerprints([t or "" for _, t in rows], 4)
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                apart += int(np.bitwise_count(fps[i] ^ fps[j])) > 4
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
                assert set(resemblance.keys(resemblance.shingles(rows[i][1] or ""))) & set(resemblance.keys(resemblance.shingles(rows[j][1] or "")))
    assert apart > 20
    least = {}
    for g, (i, _) in zip(group, rows, strict=True):
        least[g] = min(least.get(g, i), i, key=lambda x: (x is None, x))
    df = docs(spark, rows)
    kept = resemblance.keep_one(df.repartition(3))
    assert kept.dtypes == df.dtypes and sorted(x.doc_id for x in kept.collect()) == sorted(least.values())
    assert resemblance.keep_one(df.limit(0)).count() == 0


def test_near_stage_lets_tables_go(spark):
    """Texts are written once, and keys, candidates and their shingles go when they have been read."""
    import os

    r = random.Random(4)
    texts = [" ".join(r.choices([f"w{i}" for i in range(400)], k=60)) for _ in range(30)]
    df = docs(spark, list(enumerate(texts + [t + " end" for t in texts])))
    with shared.recorded(made := []):
        assert simhash.keep_one(df, words=5, similarity=True).count() == 30
    left = [path for path in made if os.path.exists(path.removeprefix("file://"))]
    assert left and not [path for path in left if os.path.basename(path).split("-")[0] in ("keys", "candidates", "named", "shingles")]
    holds = [os.path.basename(path).split("-")[0] for path in left if {"row", "text"} & set(spark.read.parquet(path).columns)]
    assert holds == ["numbered"]


def test_near_stage_by_fingerprints(spark, monkeypatch):
    """The stage gets its links from ``near_links``; similarity confirms them, and finds what they leave apart."""
    r = random.Random(5)
    texts = [" ".join(r.choices([f"w{i}" for i in range(500)], k=r.choice([0, 3, 8, 40, 300]))) for _ in range(50)]
    texts += [" ".join(w for w in t.split() if r.random() > share) for t in texts for share in (0.004, 0.02, 0.1)]
    texts += ["same fingerprint", "SAME fingerprint"]
    sets = [set(resemblance.shingles(t).tolist()) for t in texts]
    fps = simhash.fingerprints(texts, 5)
    pairs = [(j, i) for i in range(len(texts)) for j in range(i)]
    close = {p for p in pairs if int(np.bitwise_count(fps[p[0]] ^ fps[p[1]])) <= 4}
    alike = {(i, j) for i, j in pairs if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert alike - close and alike & close

    def least(links):
        group = list(range(len(texts)))
        for i, j in sorted(links):
            a, b = sorted((group[i], group[j]))
            group = [a if g == b else g for g in group]
        return group

    met, proposed, near_links, links = [], [], simhash.near_links, resemblance.links
    monkeypatch.setattr(simhash, "near_links", lambda distinct, *a: met.append(distinct.count()) or near_links(distinct, *a))

    def spied(rows, words, links_of_prints):
        place = {x.rid: texts.index(x.text) for x in rows.collect()}
        proposed.extend((place[x.a], place[x.b]) for x in links_of_prints.collect())
        return links(rows, words, links_of_prints)

    monkeypatch.setattr(resemblance, "links", spied)
    kept = corpus_pipeline.near(spark, docs(spark, list(enumerate(texts))), "")
    ids = [texts.index(t) for t in texts]  # of equal texts the first
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(least(alike)))
    assert met == [len(set(fps.tolist()))] and set(proposed) <= close | {(i, i) for i in ids} | {(j, i) for i, j in close}
    assert least(proposed + [(ids[i], i) for i in range(len(ids))]) == least(close)


def test_masks_fold():
    """Groups of long and short sets give every similar pair of different components, and no pair whose masks forbid it."""
    import pyarrow as pa

    r = np.random.default_rng(11)
    sets = []
    for n in (300, 480, 700, 900, 1000, 1100, 1900, 2100, 4000):
        base = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        sets += [base, *(np.unique(np.concatenate([base[r.random(len(base)) > share], r.integers(0, 1 << 63, int(n * more), dtype=np.uint64)])) for share, more in ((0.02, 0.02), (0.15, 0), (0, 0.2), (0.4, 0.4)))]
    member = [{"rid": i, "root": i // 2, "size": len(x), "mask": resemblance.mask(x).tolist(), "part": i % 2} for i, x in enumerate(sets)]
    kind = pa.list_(pa.struct([("rid", pa.int64()), ("root", pa.int64()), ("size", pa.int32()), ("mask", pa.list_(pa.int64())), ("part", pa.int32())]))
    want = {(i, j) for j in range(len(sets)) for i in range(j) if i // 2 != j // 2 and resemblance.similar(sets[i], sets[j])}
    whole = [m | {"part": 0} for m in member]
    for groups in ([(whole, 0, 0)], [(member, 0, 1), ([m for m in member if m["part"] == 0], 0, 0), ([m for m in member if m["part"]], 1, 1)]):
        batch = pa.RecordBatch.from_arrays([pa.array([g for g, _, _ in groups], kind), pa.array([lo for _, lo, _ in groups]), pa.array([hi for _, _, hi in groups])], names=["members", "lo", "hi"])
        got, closest = ([pair for out in resemblance._apart(c)([batch]) for pair in zip(*out.to_pydict().values(), strict=True)] for c in (False, True))
        assert set(closest) < set(got) and len(closest) >= len({(i // 2, j // 2) for i, j in closest}) == len({(i // 2, j // 2) for i, j in got})
        assert want <= set(got) and len(set(got)) == len(got) < len(want) + 10 and len(want) > 20


def test_runs_over_ranges(spark):
    """Texts with many copies go over several ranges, and a batch ends anywhere."""
    rows = awkward() + [(1000 + i, "one text") for i in range(300)] + [(2000 + i, "two") for i in range(7)]
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13", "spark.sql.execution.arrow.maxRecordsPerBatch": "5"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = docs(spark, rows).repartition(5)
        got, kept = exact_dedup.exact_groups(df).collect(), exact_dedup.drop_copies(df).collect()
        assert exact_dedup._marked(df, "text", "doc_id", True).where("edge_text = 'one text'").count() > 2
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    first = {t: min(ids, key=lambda i: (i is None, i)) for t, ids in groups.items()}
    want = [(i, first[t], len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids]
    assert sorted(map(str, want)) == sorted(str((g.doc_id, g.keep_id, g.group_size, g.text_sha256)) for g in got)
    assert sorted(map(str, first.values())) == sorted(str(g.doc_id) for g in got if g.kept) == sorted(str(r.doc_id) for r in kept)
