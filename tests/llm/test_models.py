"""Language model, toxicity, secrets and nearest neighbours."""

import bisect
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import graph_search, language_model, secrets, toxicity

AWKWARD = [(900, None), (901, ""), (902, " \t"), (None, "no id here"), (903, "Same Words"), (903, "same words"), (904, "x" * 50000), (905, "ä Ä \x1f \xa0 é")]


def prose(n, seed=1, toxic=()):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.7)) % 400}" for _ in range(5000)]
    return [(i, " ".join(r.choices(words, k=r.randint(1, 60)) + (r.choices(["vile", "scum"], k=3) if i in toxic else []))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"held_out": F.lit("x"), "score": F.lit(1), "block": F.lit(2), "row": F.lit(3), "fold": F.lit(4)})


@pytest.mark.parametrize("strength", [(300.0,), (50.0, 5.0)])
def test_scores_by_definition(spark, strength):
    rows = prose(150) + AWKWARD
    got = language_model.score(frame(spark, rows), strength=strength, block_bytes=2000).collect()
    n, start = [Counter(), Counter(), Counter()], 0
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = lambda t: [*(t or "").encode().lower().split(), "END"]
    for i, t in rows:
        if not held(i):
            z, start = tokens(t), start + 1
            n[0].update(z)
            n[1].update(zip(["START", *z], z, strict=False))
            n[2].update(zip(["START", *z], z, z[1:], strict=False))
    total, kinds = sum(n[0].values()), len(n[0])
    want = []
    for i, t in rows:
        z, base, score = tokens(t), 0.0, 0.0
        for k, w in enumerate(z):
            p = (n[0][w] + 1) / (total + kinds + 1)
            base += math.log10(p)
            v = z[k - 1] if k else "START"
            p = (n[1][v, w] + strength[0] * p) / ((n[0][v] if k else start) + strength[0])
            if k and len(strength) > 1:
                u = z[k - 2] if k > 1 else "START"
                p = (n[2][u, v, w] + strength[1] * p) / (n[1][u, v] + strength[1])
            score += math.log10(p)
        want.append((str(i), held(i), len(z), sum(n[0][w] > 0 for w in z), total, round(base, 6), round(score, 6)))
    assert sorted((str(g.doc_id), g.held_out, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 6), round(g.score, 6)) for g in got) == sorted(want)
    assert language_model.score(frame(spark, rows).limit(0)).count() == 0


def test_scores_take_trigrams(spark):
    """Without other pseudo-counts a history of two tokens counts too."""
    found = lambda **k: {r.doc_id: r.score for r in language_model.score(frame(spark, prose(80)), **k).collect()}
    got = found()
    assert got == found(strength=(3000.0, 5.0)) and got != found(strength=(3000.0,))
    numbers = np.array([0, 1, 255, 1 << 40, (1 << 64) - 1], np.uint64)
    for part in (numbers, numbers[:0]):
        assert (language_model.stretched(language_model.squeezed(part)) == part).all()


def test_shards_grow_with_input(spark, monkeypatch):
    assert language_model.shards_of(30 << 30, 12) == 1920 and language_model.shards_of(0, 12) == 12
    asked, sender = [], language_model.sender
    monkeypatch.setattr(language_model, "sender", lambda n, order: asked.append(n) or sender(n, order))
    monkeypatch.setattr(language_model, "SHARD_BYTES", 500)
    rows = prose(80)
    language_model.score(frame(spark, rows))
    assert asked == [-(-sum(len(t) for _, t in rows) // 500)] and asked[0] > 8


def test_segments_by_definition():
    """All maximal segments: found again by splitting at the best one."""
    r = random.Random(5)

    def split(s, a, b):
        best = max(((sum(s[i:j]), i - j, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0, 0))
        if best[0] <= 0:
            return []
        _, _, i, j = best
        return split(s, a, i) + [(i, j, best[0])] + split(s, j, b)

    for _ in range(150):
        s = [r.choice([-2, -1, 1, 2.5, 3.25]) + r.random() / 1000 for _ in range(r.randint(0, 14))]
        got = toxicity.segments(np.array(s))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in split(s, 0, len(s))]


def test_toxicity(spark):
    bad = set(range(0, 400, 4))
    rows = prose(400, 2, bad) + AWKWARD
    labels = spark.createDataFrame([(i, int(i in bad)) for i in range(400)] + [(3, None), (0, 0), (9999, 1)], "doc_id long, toxic int")
    df = frame(spark, rows)
    model = toxicity.fit(toxicity.learnable(df), labels)
    got = toxicity.score(df, model, carry=True)
    assert got.count() == len(rows) and got.select("row.*").dtypes == df.dtypes
    held = got.where("held_out and doc_id < 400").collect()
    assert np.mean([g.predicted == (g.doc_id in bad) for g in held]) > 0.95 and all(0 <= g.score <= 1 for g in got.collect())
    texts = dict(rows)
    for g in held:
        if g.doc_id in bad:
            assert any({"vile", "scum"} & set(texts[g.doc_id].split()[p.start : p.end]) for p in g.passages)
    assert toxicity.score(df.limit(0), model).count() == 0
    blind = toxicity.fit(toxicity.learnable(df), labels.where("toxic = 0"))
    assert {r.predicted for r in toxicity.score(df, blind).collect()} == {0}
    assert toxicity.fit(df.limit(0), labels).log_k == 0


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def entropy_spans(text, base):
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        if any(re.search(p, m[0]) for p in secrets.ALLOWED):
            continue
        most = secrets.most_c_log_c(secrets.LEAST_BITS["hex" if re.search(secrets.ONLY_HEX, m[0]) else "base64"])
        good = [i for i in range(len(m[0]) - 19) if sum(secrets.C_LOG_C[c] for c in Counter(m[0][i : i + 20]).values()) <= most]
        if good:
            a, b = m.start() + good[0], m.start() + good[-1] + 20
            near = base[max(0, bisect.bisect(base, (a, -1, 0)) - 4) : bisect.bisect(base, (b, 9, 0))]  # each kind is without overlap
            if not any(s < b and a < e for s, _, e in near):
                out.append((a, 3, b))
    return out


def test_secrets(spark):
    r = random.Random(9)
    key = lambda k, a="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/": "".join(r.choices(a, k=k))
    texts = ["", None, "password=abc", "Password : 'abcdefg'", "token=token=abcdef", "password=token: abcdefgh", "AKIA" + "A" * 16, "AKIA" + "A" * 15, "AKIAAKIA" + "B" * 20, "f" * 24, "g" + "0a" * 12 + "z", "日本 secret=" + key(12), key(40), key(64, "0123456789abcdef"), key(40, "0123456789ABCDEF"), "EXAMPLE" + key(40), "123e4567-e89b-12d3-a456-426614174000", "a" * 5000 + "1", key(3000), "api_key='" + key(30) + "' " + key(33), "x" * 100000]
    texts += ["".join(r.choices(["password", "=", ":", " ", "token", "\"", key(7), key(25), "AKIA", "ABCD1234", "é", "a1b2c3d4", "\n"], k=r.randint(1, 25))) for _ in range(300)]
    # Very many matches of all kinds in one text.
    texts.append(" ".join(r.choice([f"secret={key(8)}", "AKIA" + key(20, "ABCDEFGH0123456789"), key(24), key(30, "0123456789abcdef"), "token:" + key(40)]) for _ in range(20_000)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"assign": F.lit(1), "spans": F.lit("x")})
    began = time.time()
    got = {g.doc_id: g for g in secrets.scan(df).collect()}
    assert time.time() - began < 60
    name = lambda spans: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    for i, t in enumerate(texts):
        base = base_spans(t or "")
        g = got[i]
        assert [g.n_assign, g.n_access, g.n_hex] == [sum(s[1] == k for s in base) for k in range(3)], repr(t)[:100]
        assert g.base_sha256 == hashlib.sha256(name(base).encode()).hexdigest()
        assert g.spans == name(sorted(base + entropy_spans(t or "", base))), repr(t)[:100]
    assert secrets.scan(df.limit(0)).count() == 0


def test_neighbours(spark):
    r = np.random.default_rng(10)
    x = r.normal(size=(1500, 16)) * r.uniform(0.5, 2, size=(1500, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2020, [float("nan")] * 16), (2040, [None] + [1.0] * 15), (None, [1.0] * 16), (2061, [1.0, 2.0]), (2080, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"rank": F.lit(1), "vector": F.lit("x")})
    got = graph_search.nearest(df, shard=400, block=40).toPandas()
    hit = 0
    for q in range(0, 1500, 20):
        s = x @ x[q]
        want = [i for i in np.lexsort((np.arange(1500), -s)) if i != q][:20]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and np.allclose(own["score"], s[own["vec_id"]], rtol=1e-12) and q not in set(own["vec_id"])
        hit += len(set(want) & set(own["vec_id"]))
    assert hit / (75 * 20) >= 0.9
    assert set(got["query_id"]) == {*range(0, 1500, 20), 2080} and got[got.query_id == 2080]["vec_id"].tolist() == [2061]


def test_copies_and_ties(spark):
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(i, [0.0, 1.0]) for i in range(60, 65)] + [(0, [1.0, 0.0]), (100, [-1.0, 0.0])]
    got = graph_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).toPandas()
    of = lambda q: got[got.query_id == q].sort_values("rank")["vec_id"].tolist()
    assert of(0) == list(range(1, 21)) and of(40) == list(range(20)) and of(60) == [61, 62, 63, 64, *range(16)] and of(100) == [60, 61, 62, 63, 64, *range(15)]
    assert graph_search.nearest(spark.createDataFrame(rows[:0], "vec_id long, embedding array<float>")).count() == 0


def test_pieces_of_a_text_meet():
    """A text read in short pieces weighs what it weighs when read as one."""
    import pyarrow as pa

    texts = [t for _, t in prose(40)] + ["", "one", " ".join(["a b c d"] * 300)]
    for strength in ((300.0,), (50.0, 5.0)):
        table = pa.table({"text": texts, "block": [0] * len(texts), "held_out": [i % 3 == 0 for i in range(len(texts))]})
        answer = language_model.adder(language_model.sender(1, len(strength) + 1)(table))
        grams = language_model.Grams(texts, len(strength) + 1)
        single_n = np.empty(len(grams.words))
        single_n[grams.by_hash] = language_model.stretched(answer.column("single_n")[0].as_py())
        longer_n = language_model.stretched(answer.column("longer_n")[0].as_py()).astype(float)
        automaton = language_model.Automaton(grams, single_n, longer_n, answer.column("tokens")[0].as_py(), answer.column("types")[0].as_py(), strength)
        whole = automaton.read(grams.tokens, grams.first, grams.size, piece=1 << 20)
        for piece in (2, 3, 128):
            assert np.allclose(automaton.read(grams.tokens, grams.first, grams.size, piece), whole, atol=1e-12)


def test_toxicity_by_definition(spark):
    """Lexicon, K and curve as their definitions have them."""
    bad = set(range(0, 400, 4))
    rows = [(i, t) for i, t in prose(400, 2, bad)]
    labels = spark.createDataFrame([(i, int(i in bad)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.learnable(frame(spark, rows)), labels)
    crc = lambda i: zlib.crc32(str(i).encode())
    train = [(t.split(), crc(i) % 10 // 5, int(i in bad)) for i, t in rows if crc(i) % 5]

    def lexicon(folds):
        n = [Counter(), Counter()]
        for words, fold, y in train:
            if fold in folds:
                n[y].update({toxicity.plain(w) for w in words})
        total, out = [sum(n[0].values()), sum(n[1].values())], {}
        for w in n[0] | n[1]:
            y0, y1 = n[0][w], n[1][w]
            expected = [(y0 + y1) * x / sum(total) for x in total]
            g = 2 * sum(y * math.log(y / e) for y, e in zip((y0, y1), expected, strict=True) if y)
            prior = 500 * (y0 + y1) / sum(total)
            a, b = (y1 + prior) / (total[1] + 500), (y0 + prior) / (total[0] + 500)
            out[w] = (math.log(a / (1 - a)) - math.log(b / (1 - b))) * max(0, 1 - 25 / max(g, 1e-9)) - 0.1, b
        excess = lambda x: sum(b * math.exp(x * s) for s, b in out.values()) - 1
        low, high = 1e-6, 64.0
        for _ in range(100):
            middle = (low + high) / 2
            low, high = (middle, high) if excess(middle) < 0 else (low, middle)
        return {w: s * high for w, (s, _) in out.items()}, -0.1 * high

    def best(words, scores):
        s = np.cumsum([0.0, *(scores[0].get(toxicity.plain(w), scores[1]) for w in words)])
        return max((s[j] - s[i] for i in range(len(s)) for j in range(i + 1, len(s))), default=0.0)

    whole, other = lexicon((0, 1))
    assert math.isclose(model.words.other, other, rel_tol=1e-6) and {"vile", "scum"} <= set(model.words.scores)
    for w, s in whole.items():
        assert math.isclose(model.words.score(w), s, rel_tol=1e-6), w
    halves = [lexicon((0,)), lexicon((1,))]
    clean = [len(words) * math.exp(-max(0.0, best(words, halves[1 - fold]))) for words, fold, y in train if not y]
    assert math.isclose(model.log_k, -math.log(sum(clean) / len(clean)), rel_tol=1e-6)
    assert (np.diff(model.curve) >= 0).all()
    r = np.random.default_rng(5)
    n0, n1 = r.integers(0, 9, 30).astype(float), r.integers(0, 9, 30).astype(float)
    rate = (n1.sum() + 0.5) / (n0.sum() + n1.sum() + 1)
    w, y = n0 + n1 + 1e-3, n1 + 1e-3 * rate
    pooled = lambda i, j: y[i : j + 1].sum() / w[i : j + 1].sum()
    level = [max(min(pooled(i, j) for j in range(k, 30)) for i in range(k + 1)) for k in range(30)]
    got = toxicity.monotone(n0, n1)
    for k in range(30):
        block = [j for j in range(30) if math.isclose(level[j], level[k])]
        assert math.isclose(got[k], (y[block].sum() + rate) / (w[block].sum() + 1))


@pytest.mark.parametrize("size", [1e25, 1e-25, 1e140])
def test_nearest_of_any_size(spark, size):
    """Vectors of any finite size take part."""
    r = np.random.default_rng(4)
    x = r.normal(size=(300, 8)) * size
    got = graph_search.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), shard=150).toPandas()
    hits = 0
    for q in range(0, 300, 20):
        own = x @ x[q]
        own[q] = -np.inf
        found = got[got.query_id == q].sort_values("rank")
        assert len(found) == 20 and np.allclose(found["score"], own[found["vec_id"]], rtol=1e-12)
        hits += len(set(found["vec_id"]) & set(np.argsort(-own)[:20].tolist()))
    assert hits >= 0.9 * 15 * 20
