"""Language of whole texts by multinomial naive Bayes over hashed character n-grams.

A text is read as lower-case letters with one space for all between words; its n-grams of
one to ``LONGEST`` characters are hashed to buckets.  Learning counts buckets by language
in every task in one array and adds the tasks' counts up in Spark, over all
rows that may be learnt from.  The matrix of log-probabilities is broadcast, and a batch
of texts is scored by sums over its n-grams, language after language.

The matrix has at most ``CELLS`` cells: 65,536 buckets for up to 512 languages, and half as
many whenever the languages double; more than 131,072 languages are an error, as such a
column does not name languages.  Nothing else that is broadcast or reaches the driver
grows with the documents.

Defined cases: a null text or one without a letter is ``und`` with score 0.  Null
languages are not learnt from; without any language every text is ``und``.  Of equally
likely languages the one first by code point is taken.  Repeated rows count as often as
they come and are predicted each for itself; a null id counts as the empty text in the
fold.  A text of any length is read in parts of ``PART`` characters that carry the last
letters of the part before, so it counts as one.  An empty table gives an empty result.
Nothing but the text enters a prediction; other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.shared import id_remainder, slices, stash, text_of

#: Longest n-gram, cells of the matrix, most buckets, count that every bucket has beforehand.
LONGEST, CELLS, BUCKETS, SMOOTHING = 3, 1 << 25, 1 << 16, 0.1
#: Characters that are hashed at a time.
PART = 1 << 19
FOLDS, HELD_OUT = 4, 2
SPACE = 32
MIX = np.uint64(0x9E3779B97F4A7C15)


@cache
def folded() -> np.ndarray:
    """Lower case of each code point that is a letter, and a space for all others."""
    table = np.full(0x110000, SPACE, np.uint32)
    for c in range(0x110000):
        letter = chr(c)
        if letter.isalpha():
            low = letter.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def letters(text: str) -> Iterator[tuple[np.ndarray, int]]:
    """Parts of a text in folded letters and the number of characters at the start of each
    that the part before had already."""
    carried = np.array([SPACE], np.uint32)
    for at in range(0, len(text), PART):
        codes = np.frombuffer(text[at : at + PART].encode("utf-32-le", "replace"), np.uint32)
        new = folded()[codes]
        new = new[(new != SPACE) | (np.concatenate([carried[-1:], new[:-1]]) != SPACE)]
        both = np.concatenate([carried, new])
        yield both, len(carried)
        carried = both[-(LONGEST - 1) :] if LONGEST > 1 else both[-1:]


def grams(codes: np.ndarray, row: np.ndarray, fresh: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams that end at a fresh character, and their rows.  Single
    spaces are no n-grams."""
    found, rows, held = [], [], np.zeros(len(codes), np.uint64)
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    for n in range(1, LONGEST + 1):
        if len(codes) < n:
            break
        # held[i]: hash of the n characters from i.
        held = (held[: len(codes) - n + 1] + codes[n - 1 :].astype(np.uint64) + np.uint64(n)) * MIX
        held ^= held >> np.uint64(29)
        good = fresh[n - 1 :] & (row[n - 1 :] == row[: len(codes) - n + 1])
        if n == 1:
            good = good & (codes != SPACE)
        found.append(((held[good] * MIX) >> shift).astype(np.int64))
        rows.append(row[n - 1 :][good])
    return (np.concatenate(found), np.concatenate(rows)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


def gathered(texts: pa.Array, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets and rows of all n-grams of a batch, some ``PART`` characters at a time."""
    held, size = [], 0

    def flush():
        codes = np.concatenate([c for _, c, _ in held])
        row = np.concatenate([np.full(len(c), r) for r, c, _ in held])
        fresh = np.concatenate([np.arange(len(c)) >= old for _, c, old in held])
        return grams(codes, row, fresh, buckets)

    for r, value in enumerate(texts):
        for codes, old in letters(value.as_py()):
            # Parts of one text follow each other in blocks of their own.
            held.append((r, codes, old))
            size += len(codes)
            if size >= PART:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def count_grams(languages: list[str], buckets: int):
    """Rows (language number, bucket, n) of what a task has counted."""
    number = {name: i for i, name in enumerate(languages)}

    def run(batches):
        counts = np.zeros(len(languages) * buckets, np.int64)
        for whole in batches:
            for b in slices(whole, "text"):
                of = np.array([number[x] for x in b.column("lang").to_pylist()])
                for bucket, row in gathered(b.column("text"), buckets):
                    np.add.at(counts, of[row] * buckets + bucket, 1)
        at = np.flatnonzero(counts)
        for cut in range(0, len(at), 10_000):
            k = at[cut : cut + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array((k // buckets).astype(np.int32)), pa.array((k % buckets).astype(np.int32)), pa.array(counts[k])], names=["language", "bucket", "n"])

    return run


class Model:
    """Languages and their log-probabilities: priors and a row of buckets each."""

    def __init__(self, languages: list[str], prior: np.ndarray, table: np.ndarray):
        self.languages, self.prior, self.table = languages, prior, table


def learnable(docs: DataFrame, id: str = "doc_id") -> DataFrame:
    """The rows that may be learnt from."""
    return docs.where(id_remainder(id, FOLDS) != HELD_OUT)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learn from all rows of ``docs`` that have a language."""
    known = docs.where(F.col(lang).isNotNull()).select(text_of(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    sizes = known.groupBy("lang").count().limit((1 << 17) + 1).collect()
    if len(sizes) > 1 << 17:
        raise ValueError("more than 131,072 languages")
    languages = sorted(r.lang for r in sizes)
    buckets = BUCKETS
    while len(languages) * buckets > CELLS:
        buckets //= 2
    counts = np.zeros((len(languages), buckets), np.float64)
    if languages:
        parts = known.mapInArrow(count_grams(languages, buckets), "language int, bucket int, n long")
        summed = stash(parts.groupBy("language", "bucket").agg(F.sum("n").alias("n")), "gram-counts").toArrow()  # at most CELLS rows
        counts[summed.column("language").to_numpy(), summed.column("bucket").to_numpy()] = summed.column("n").to_numpy()
    of = {r.lang: r["count"] for r in sizes}
    prior = np.log(np.array([of[name] for name in languages], float) / max(1, sum(of.values())))
    table = np.log((counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * buckets))
    return Model(languages, prior, table.astype(np.float32))


def scored(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and its probability for each text of a batch."""
    rows, buckets = len(texts), model.table.shape[1]
    total, seen = np.tile(model.prior, (rows, 1)), np.zeros(rows, bool)
    for bucket, row in gathered(texts, buckets):
        seen[row] = True
        for k, logs in enumerate(model.table):
            total[:, k] += np.bincount(row, logs[bucket], rows)
    if not model.languages:
        return ["und"] * rows, np.zeros(rows)
    best = total.argmax(axis=1)
    chance = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    return [model.languages[k] if s else "und" for k, s in zip(best, seen, strict=True)], np.where(seen, chance, 0.0)


def scorer(model):
    def run(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                names, chance = scored(model.value, b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(chance)], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row."""
    held_out: Column = id_remainder(id, FOLDS) == HELD_OUT
    plain = docs.select(F.col(id).cast("long").alias("doc_id"), held_out.alias("held_out"), text_of(text).alias("text"))
    return plain.mapInArrow(scorer(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, held_out boolean, lang_pred string, score double")
