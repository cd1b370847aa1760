"""Conversation repair, fill-in-middle and language identification."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import conversations, fill_middle, language_id

PATTERN = r"(s?(ua)+)?"


def cheapest(codes):
    """Cheapest edits by trying all, of which the least audit."""
    best = (10**9, "")

    def go(i, letters, audit, cost, inserts):
        nonlocal best
        if cost > best[0] or not re.fullmatch(r"s?(ua)*u?", letters):
            return
        if i == len(codes) and re.fullmatch(PATTERN, letters):
            best = min(best, (cost, audit))
        if i < len(codes):
            c = codes[i]
            go(i + 1, letters, audit + "D", cost + 4, 0)
            if c != "d":
                charge = 3 * c.isupper()
                if c.lower() != "x":
                    go(i + 1, letters + c.lower(), audit + "K", cost + charge, 0)
                for letter in "ua":
                    go(i + 1, letters + letter, audit + "R", cost + 3 + charge, 0)
        if inserts < 3:
            for letter in "ua":
                go(i, letters + letter, audit + "I", cost + 3, inserts + 1)

    go(0, "", "", 0, 0)
    return best


def folded(codes, size):
    fold = conversations.Fold()
    for k in range(0, len(codes), size):
        ways = [{"start": q, "end": e, "cost": c, "audit": a} for q in range(4) for e, c, a in conversations.search(codes[k : k + size], q, False)]
        fold.add({"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "initials": "u", "turns": 0, "low": None, "high": None, "alone": False, "ways": ways})
    return fold.done()


def test_search_is_cheapest_and_least():
    r = random.Random(1)
    for _ in range(250):
        codes = "".join(r.choices("dsuaxSUAXuaua", k=r.randint(0, 6)))
        ((_, *found),) = conversations.search(codes, 0, True)
        assert tuple(found) == cheapest(codes), codes
        for size in (1, 2, 3):
            assert folded(codes, size) == cheapest(codes), (codes, size)
    for _ in range(60):
        codes = "".join(r.choices("dsuaxSUAXuaua", k=r.randint(50, 300)))
        ((_, *found),) = conversations.search(codes, 0, True)
        assert all(folded(codes, size) == tuple(found) for size in (1, 7, 64))


def expected(rows):
    """What the contract says of (conv_id, turn, role, text) rows, one conversation at a time."""
    some, held, out = lambda x: " " if x is None else str(x), {}, {}
    for conv, turn, role, text in rows:
        mine = held.setdefault(conv, [])
        role, text = some(role), some(text)
        kind = zlib.crc32(f"{some(conv)}:{some(turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        mine += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, mine in held.items():
        mine.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).digest()))
        codes, seen, count = "", set(), dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in mine:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                count[fault] += 1
            letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
            codes += "d" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        ((_, cost, audit),) = conversations.search(codes, 0, True)
        assert len(codes) > 7 or (cost, audit) == cheapest(codes)
        lines, at, letters = [], 0, ""
        for edit in audit:
            adds = "user" if letters in ("", "s") or letters[-1] == "a" else "assistant"
            if edit != "I":
                at += 1
            if edit != "D":
                role, text = (mine[at - 1][1] if edit == "K" else adds), ("" if edit == "I" else mine[at - 1][2])
                lines.append(f"{role}:{text}")
                letters += role[0]
        assert re.fullmatch(PATTERN, letters)
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        out[conv] = (gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def talks(spark):
    r, rows = random.Random(3), []
    for conv in range(60):
        for turn in range(r.randint(1, 7)):
            rows.append((conv, turn if r.random() > 0.05 else None, r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "ünder"]), r.choice(["Yes.", "So be it!\n", "cut off", "", None, "é?", " \t\r", "word. " * 50])))
    rows += [(None, 0, "user", "Who?"), (None, 1, "assistant", "Me."), (None, None, None, None), (70, None, "user", None)]
    rows += [(71, t, "user" if t % 2 == 0 else "assistant", f"Line {t % 300}." + "long " * (2000 * (t == 5))) for t in range(700)] * 2
    rows += [(72, 3, "user", "The same.")] * 900
    return rows


def test_audits(spark, talks):
    rows = spark.createDataFrame(talks, "conv_id int, turn int, role string, text string").repartition(5).withColumns({"kind": F.lit("x"), "block": F.lit(1), "digest": F.lit(2), "place": F.lit(3)})
    got = {r.conv_id: tuple(r)[1:] for r in conversations.audit(rows, conversations.damaged(rows)).collect()}
    want = expected(talks)
    assert len(got) == len(want) == 64
    for conv, row in want.items():
        assert got[conv] == row, conv
    assert conversations.audit(rows.limit(0), conversations.damaged(rows.limit(0))).count() == 0


def test_repaired_rows(spark, talks):
    rows = spark.createDataFrame(talks, "conv_id int, turn int, role string, text string")
    fixed = conversations.damaged(rows)
    lines, seen = {}, conversations.repair(fixed).collect()
    for r in sorted(seen, key=lambda r: r.place):
        assert r.place == len(lines.setdefault(r.conv_id, []))
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    for conv, row in expected(talks).items():
        assert hashlib.sha256("\n".join(lines.get(conv, [])).encode()).hexdigest() == row[-1]
    assert {r.edit for r in seen} == {"K", "R", "I"}
    # A repaired conversation without truncated rows needs no further edit.
    again = spark.createDataFrame([(r.conv_id, r.place, r.role, r.text or "Added.") for r in seen], "conv_id int, turn int, role string, text string")
    audits = conversations.audit(again, conversations.ordered_rows(again))
    assert audits.where("duplicate = 0 and audit rlike '[^K]'").count() == 0


def test_rank_and_select():
    r = np.random.default_rng(5)
    for size in (0, 1, 63, 64, 511, 512, 513, 5000):
        for density in (0.01, 0.5, 1.0):
            ones = r.random(size) < density
            words = np.zeros(-(-size // 64) + 1, np.uint64)
            packed = np.packbits(ones, bitorder="little")
            words.view(np.uint8)[: len(packed)] = packed
            bits, at = fill_middle.Bits(words), np.flatnonzero(ones)
            assert bits.rank(np.arange(size + 1)).tolist() == np.concatenate([[0], np.cumsum(ones)]).tolist()
            if len(at):
                assert bits.select(np.arange(len(at))).tolist() == at.tolist()


def middles():
    r = random.Random(8)
    parts = ["a", "Bc", " ", "\n", "é", "漢", "😀", ".", "1", "<", "P", ">", "<P", "S>"]
    return ["", None, "a", "é", "word", "x <S> y", "<M>", "<P", "ab" * 300_000, "zé😀" * 400_000, *["".join(r.choices(parts, k=r.randint(0, 60))) for _ in range(500)]]


def test_fill_middle(spark, monkeypatch):
    monkeypatch.setattr(fill_middle, "PART", 1 << 10)
    texts = middles()
    docs = spark.createDataFrame([*enumerate(texts), (None, "no id at all"), (5, "x <S> y")], "doc_id long, text string").withColumns({"n": F.lit("x"), "cut": F.lit(1), "form": F.lit(2), "h1": F.lit(3)})
    found = fill_middle.restore(fill_middle.transform(docs)).collect()
    assert len(found) == len(texts) + 2
    forms = set()
    for row in found:
        text = "no id at all" if row.doc_id is None else texts[row.doc_id] or ""
        tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        key = hashlib.sha256(f"1:{'' if row.doc_id is None else row.doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(key[8 * i : 8 * i + 8], 16) for i in range(4))
        a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
        p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
        form = "plain" if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
        assert (row.n, row.form, row.restored) == (len(tokens), form, text)
        assert row.output == {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        assert (row.prefix_chars, row.middle_chars) == ((None, None) if form == "plain" else (len(p), len(m)))
        forms.add(form)
    assert forms == {"plain", "psm", "spm"}
    assert fill_middle.transform(docs.limit(0)).count() == 0


def test_parts_of_a_text_count_as_one(monkeypatch):
    text = "Ça va?  12 " * 500 + "ŒUVRE\n\n\n" + "x" * 700 + "  !!  end" * 300
    whole = [np.sort(b).tolist() for b, _ in language_id.gathered(pa.array([text]), 1 << 16)]
    low = re.sub(r"[\W\d_]+", " ", " " + text.lower())
    assert len(whole[0]) == sum(len(low) - max(1, n - 1) for n in range(2, language_id.LONGEST + 1)) + sum(c != " " for c in low)
    for part in (1, 2, 3, 64, 1000):
        monkeypatch.setattr(language_id, "PART", part)
        assert np.sort(np.concatenate([b for b, _ in language_id.gathered(pa.array([text]), 1 << 16)])).tolist() == whole[0]
        monkeypatch.undo()


def test_probabilities_are_those_of_the_definition(spark):
    r, alphabets = random.Random(6), {"en": "etaoin ", "de": "enisrü ", "fr": "esaité "}
    rows = [(i, "".join(r.choices(alphabets[lang], k=r.randint(5, 200))), lang) for i, lang in enumerate(r.choices(sorted(alphabets), k=400))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(language_id.learnable(docs))
    counts, sizes = {k: {} for k in alphabets}, dict.fromkeys(alphabets, 0)
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            sizes[lang] += 1
            for found, _ in language_id.gathered(pa.array([text]), language_id.BUCKETS):
                for b in found.tolist():
                    counts[lang][b] = counts[lang].get(b, 0) + 1
    total = {k: sum(c.values()) for k, c in counts.items()}
    right = 0
    for row in language_id.predict(docs, model).collect():
        text, lang = rows[row.doc_id][1:]
        (found,) = [b for b, _ in language_id.gathered(pa.array([text]), language_id.BUCKETS)] or [np.empty(0, int)]
        logs = {k: np.log(sizes[k] / sum(sizes.values())) + sum(np.log((counts[k].get(b, 0) + 0.1) / (total[k] + 0.1 * language_id.BUCKETS)) for b in found.tolist()) for k in alphabets}
        best = max(sorted(logs), key=logs.get)
        if text.strip():
            assert row.lang_pred == best and row.score == pytest.approx(1 / sum(np.exp(v - logs[best]) for v in logs.values()), abs=1e-3)
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 4 == 2)
        right += row.lang_pred == lang
    assert right > 360


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.predict(docs, language_id.fit(language_id.learnable(docs))).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.98


def test_language_cases(spark):
    rows = [(None, "null id text", "en"), (1, None, "en"), (2, "", "de"), (3, "12 !!", "de"), (4, "die und der", None), *[(i, "der und die", "de") for i in range(5, 30)], (5, "der und die", "de"), (40, "the and of", "en"), (41, "the of " * 300_000, "en"), (42, "ǅ ß İ ŉ", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"held_out": F.lit("x"), "score": F.lit(1), "n": F.lit(2), "bucket": F.lit(3)})
    got = language_id.predict(docs, language_id.fit(language_id.learnable(docs)))
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == len(rows)
    held = {r.doc_id: r for r in got.collect()}
    assert [held[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and held[4].lang_pred == "de" and held[41].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in held.values()) and held[1].score == 0
    none = language_id.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language_id.predict(docs, none).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), language_id.fit(docs.limit(0))).count() == 0
