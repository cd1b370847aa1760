"""Toxic passages by maximum-scoring segments, with extreme-value calibration.

Every token has a score: the log-odds of its rates among the distinct tokens of toxic and clean labelled texts
under a Dirichlet prior with the rates of both together, shrunk to nothing as its
distance from equal rates nears ``ERRORS`` standard errors.  A linear-time scan (Ruzzo and Tompa) finds all maximal segments
of a text's token scores.  A segment of score S in a text of n tokens is expected by
chance E = K n exp(-lambda S) times; lambda solves sum(p exp(lambda s)) = 1 over the
clean rates, and K is fitted to the best segments of clean texts.  Segments with E < 1
are passages; their evidence, -ln E, is added up.  A monotone curve fitted on the
labelled texts turns evidence into a probability.

Learning reads all labelled training rows and counts every token in Spark.  The lexicon is
of bounded size, as any vocabulary: of the tokens beyond ``ERRORS`` standard errors the ``LEXICON``
farthest from equal rates reach the driver and the executors, and all others have one score.  Training texts are scored
for K and the curve with the counts of the other of two folds.

Defined cases: a null text is the empty text; a text without tokens has no passage
and its evidence is the lowest.  Null labels are left out; of repeated labels the
largest counts.  Repeated rows are scored each for itself.  Without labels of both
kinds all scores are the same.  An empty table gives an empty result.  Nothing but the
text enters a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from tidegauge.llm.shared import frugal, id_remainder, stash, text_of

#: Pseudo-tokens of the prior, standard errors that a token needs, and what each token costs a segment.
PRIOR, ERRORS, DRIFT = 500.0, 5.0, 0.1
#: Tokens of the lexicon at most.
LEXICON = 1 << 17
#: The curve's grid over evidence.
LOW, HIGH, BINS = -24.0, 72.0, 384
PUNCTUATION = ".,;:!?\"'()[]{}«»„“”…-*_"
REMEMBERED = 1 << 17


def plain(token: str) -> str:
    """A token without punctuation around it, in lower case."""
    return token.strip(PUNCTUATION).lower()


class Remembered(dict):
    """token -> what ``make`` gives for it, for a bounded number of tokens."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, token: str):
        if len(self) > REMEMBERED:
            self.clear()
        value = self[token] = self.make(token)
        return value


@frugal
def count_tokens(batches):
    """Rows (token, fold, toxic, n): in how many labelled texts of a task a token is.

    Texts count, not occurrences, as a text repeats its own words.
    """
    counts, of, names = {}, Remembered(plain), ["token", "fold", "toxic", "n"]

    def counted():
        for (fold, toxic), held in counts.items():
            token, n = pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())
            for cut in range(0, len(n), 10_000):
                k = min(10_000, len(n) - cut)
                yield pa.RecordBatch.from_arrays([token[cut : cut + k], pa.array(np.full(k, fold, np.int32)), pa.array(np.full(k, toxic, np.int32)), n[cut : cut + k]], names=names)

    for b in batches:
        for text, fold, toxic in zip(b.column("text"), b.column("fold").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            counts.setdefault((fold, toxic), Counter()).update({of[w] for w in text.as_py().split()})
        if sum(map(len, counts.values())) > REMEMBERED:
            yield from counted()
            counts.clear()
    yield from counted()


def distance_sql(clean: str, toxic: str, all_clean: float, all_toxic: float) -> str:
    """How far counts are from those of equal rates, in squared standard errors (the G statistic)."""
    part = lambda y, total: f"({y}) * ln(greatest({y}, 1e-9D) / greatest(({clean} + {toxic}) * {total / (all_clean + all_toxic)!r}D, 1e-9D))"
    return f"2 * ({part(toxic, all_toxic)} + {part(clean, all_clean)})" if all_clean and all_toxic else "0D"


class Lexicon:
    """Scores of the significant tokens in units of 1/lambda, and that of all others.

    ``g``: each token's distance from equal rates; ``all_clean`` and ``all_toxic``: the
    sums of the counts of all tokens, these and others.
    """

    def __init__(self, tokens: list[str], clean: np.ndarray, toxic: np.ndarray, g: np.ndarray, all_clean: float, all_toxic: float):
        self.scores, self.other = {}, -DRIFT
        if not all_clean or not all_toxic:
            return
        prior = PRIOR * (clean + toxic) / (all_clean + all_toxic)
        a, b = (toxic + prior) / (all_toxic + PRIOR), (clean + prior) / (all_clean + PRIOR)
        score = (np.log(a / (1 - a)) - np.log(b / (1 - b))) * np.maximum(0, 1 - ERRORS**2 / np.maximum(g, 1e-9)) - DRIFT
        unit = 1.0
        if (score > 0).any():
            low, high, rest = 1e-6, 1.0, 1 - b.sum()
            excess = lambda x: b @ np.exp(np.minimum(x * score, 700)) + rest * np.exp(-x * DRIFT) - 1
            while excess(high) < 0 and high < 100:
                high *= 2
            for _ in range(60):
                middle = (low + high) / 2
                low, high = (middle, high) if excess(middle) < 0 else (low, middle)
            unit = high
        self.scores, self.other = dict(zip(tokens, (score * unit).tolist(), strict=True)), -DRIFT * unit

    def score(self, token: str) -> float:
        return self.scores.get(plain(token), self.other)


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), by one scan.

    A stack of segments, each with the running total before it and at its end.  A new
    one joins all since the last segment that begins lower, if that one ends lower.
    """
    total = np.concatenate([[0.0], np.cumsum(score)])
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, before, at end, the last one that begins lower
    for i in np.flatnonzero(score > 0).tolist():
        start, end, before, after = i, i + 1, total[i], total[i + 1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= before:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= after:
                stack.append((start, end, before, after, j))
                break
            start, before = stack[j][0], stack[j][2]
            del stack[j:]
    return [(s, e, float(b - a)) for s, e, a, b, _ in stack]


def training_segments(lexicons):
    """Rows (toxic, n, best scores) of labelled texts, each with the other fold's lexicon."""

    @frugal
    def run(batches):
        of = [Remembered(x.score) for x in lexicons.value]
        for b in batches:
            n, best = [], []
            for text, fold in zip(b.column("text"), b.column("fold").to_pylist(), strict=True):
                tokens, get = text.as_py().split(), of[1 - fold]
                n.append(len(tokens))
                best.append([s for _, _, s in segments(np.array([get[w] for w in tokens]))])
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(n, pa.int64()), pa.array(best, pa.list_(pa.float64()))], names=["toxic", "n", "scores"])

    return run


def monotone(clean: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Rate of toxic texts in each bin, made non-decreasing by pooling neighbours."""
    rate = (toxic.sum() + 0.5) / (clean.sum() + toxic.sum() + 1)
    blocks: list[list[float]] = []  # weight, weighted rate, bins
    for c, t in zip(clean, toxic, strict=True):
        w = float(c + t) + 1e-3
        blocks.append([w, float(t) + 1e-3 * rate, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last, strict=True)]
    return np.concatenate([np.full(int(n), (t + rate) / (w + 1)) for w, t, n in blocks])


class Model:
    """What scoring needs: the lexicon, ln K and the curve."""

    def __init__(self, words: Lexicon, log_k: float, curve: np.ndarray):
        self.words, self.log_k, self.curve = words, log_k, curve

    def chance(self, evidence: np.ndarray) -> np.ndarray:
        at = np.clip((evidence - LOW) / (HIGH - LOW) * BINS - 0.5, 0, BINS - 1)
        # The slight slope keeps the order of texts that share a step of the curve.
        return np.clip(np.interp(at, np.arange(BINS), self.curve) * (1 - 1e-4) + 1e-4 * at / BINS, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "toxic") -> Model:
    """Learn from the rows of ``docs`` that ``labels`` covers; both are read whole."""
    spark = docs.sparkSession
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(id).alias("label_id")).agg((F.max(label) > 0).cast("int").alias("toxic"))
    plain = docs.select(F.col(id).alias("label_id"), text_of(text).alias("text"), F.floor(id_remainder(id, 10) / 5).cast("int").alias("fold"))
    # Labels grow with the documents, so both are always dealt by id, at any size.
    train = stash(plain.join(known.hint("merge"), "label_id").select("text", "fold", "toxic"), "labelled")
    folds = [(f, t) for f in (0, 1) for t in (0, 1)]
    each = [F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == t), F.col("n")).otherwise(0)).alias(f"n{f}{t}") for f, t in folds]
    counts = stash(train.mapInArrow(count_tokens, "token string, fold int, toxic int, n long").groupBy("token").agg(*each), "token-counts")
    total = [float(x or 0) for x in counts.agg(*[F.sum(f"n{f}{t}") for f, t in folds]).first()]
    # The first fold, the second one and both.
    views = [("n00", "n01", *total[:2]), ("n10", "n11", *total[2:]), ("n00 + n10", "n01 + n11", total[0] + total[2], total[1] + total[3])]
    far = [F.expr(distance_sql(*view)).alias(f"g{i}") for i, view in enumerate(views)]
    farthest = F.greatest("g0", "g1", "g2")
    kept = counts.select("*", *far).where(farthest > ERRORS**2).orderBy(farthest.desc(), "token").limit(LEXICON).toArrow()
    tokens, n = kept.column("token").to_pylist(), {c: kept.column(c).to_numpy().astype(float) for c in kept.schema.names[1:]}
    pairs = [(n["n00"], n["n01"]), (n["n10"], n["n11"]), (n["n00"] + n["n10"], n["n01"] + n["n11"])]
    *halves, whole = [Lexicon(tokens, *pair, n[f"g{i}"], *view[2:]) for i, (pair, view) in enumerate(zip(pairs, views, strict=True))]
    lexicons = spark.sparkContext.broadcast(halves)
    scored = stash(train.mapInArrow(training_segments(lexicons), "toxic int, n long, scores array<double>"), "training-segments")
    clean = scored.where("toxic = 0").select(F.avg(F.col("n") * F.exp(-F.coalesce(F.array_max("scores"), F.lit(0.0))))).first()[0]
    log_k = float(-np.log(clean)) if clean else 0.0
    seen = scored.select("toxic", F.expr(evidence_sql(log_k)).alias("evidence"))
    bins = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.col("evidence") - LOW) / (HIGH - LOW) * BINS))).cast("int")
    held = np.zeros((2, BINS))
    for toxic, at, n in seen.groupBy("toxic", bins.alias("bin")).count().collect():  # at most 2 * BINS rows
        held[toxic, at] = n
    return Model(whole, log_k, monotone(*held))


def evidence_sql(log_k: float) -> str:
    """-ln E of the passages together, or of the best segment if there is no passage."""
    each = f"transform(scores, s -> s - ln(n + 1) - ({log_k!r}D))"
    return f"if(array_max({each}) > 0, aggregate(filter({each}, x -> x > 0), 0D, (a, x) -> a + x), coalesce(array_max({each}), -ln(n + 1) - ({log_k!r}D)))"


PASSAGES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("evidence", pa.float64())]))
JUDGED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("passages", from_arrow_type(PASSAGES))])


def scorer(model):
    @F.arrow_udf(JUDGED)
    @frugal
    def judged(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fitted = model.value
        of = Remembered(fitted.words.score)
        for batch in texts:
            evidence, passages = np.zeros(len(batch)), []
            for row, text in enumerate(batch):
                tokens = text.as_py().split()
                chance = np.log(len(tokens) + 1) + fitted.log_k
                found = [(s, e, x - chance) for s, e, x in segments(np.array([of[w] for w in tokens]))]
                good = [f for f in found if f[2] > 0]
                evidence[row] = sum(f[2] for f in good) if good else max((f[2] for f in found), default=-chance)
                passages.append([{"start": s, "end": e, "evidence": x} for s, e, x in good])
            yield pa.StructArray.from_arrays([pa.array(fitted.chance(evidence)), pa.array(passages, PASSAGES)], names=["score", "passages"])

    return judged


def score(docs: DataFrame, model: Model, carry: bool = False, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted and passages (words from, to, evidence) of
    each row; with ``carry`` also ``row``, the whole input row.  Only texts go to Python
    workers; what is carried stays in the JVM."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    plain = docs.select(F.col(id).cast("long").alias("doc_id"), (id_remainder(id, 5) == 0).alias("held_out"), text_of(text).alias("text"), *row)
    found = plain.withColumn("found", scorer(docs.sparkSession.sparkContext.broadcast(model))("text"))
    return found.select("doc_id", "held_out", "found.score", "found.passages", *["row"][: len(row)], (F.col("found.score") >= 0.5).cast("int").alias("predicted"))


def learnable(docs: DataFrame, id: str = "doc_id") -> DataFrame:
    """The rows that may be learnt from."""
    return docs.where(id_remainder(id, 5) != 0)
