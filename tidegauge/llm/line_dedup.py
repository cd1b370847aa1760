"""Line deduplication by pairwise alignment.

Lines are known by the hash of their words.  A line of ``least_words`` words, or the shortest
run of lines that has as many from or to a line of fewer, is rare enough to name a passage:
documents that share the hash of one are linked to the earliest holder of it.  Every block
that can go has one inside, so some partner holds it; and the links grow with the
lines, never with the square of a hash's holders.

Each linked pair is aligned by patience diff: lines that are unique in both and in the same
order anchor the alignment, which grows over equal neighbours and goes on between anchors.
A gap without such lines is aligned on the runs that its sides share, in order.  Blocks of aligned lines
with at least ``least_words`` words are deleted from the later document.  What it has left is then
aligned run by run out of order, so that moved blocks and further copies of a passage go
as well: afterwards no run of enough words that is left stands in the earlier document.
A line that two blocks could take goes with the one that the alignment takes.  What several pairs delete is joined.

Only hashes of lines are exchanged until the end, when each text meets its deletions.
Hashes that a large part of the documents hold, and documents that are the earliest holder for
many, are spread: both are counted first, and so few can be as frequent as that (see
``SHARE``) that their list is small at any size.

Defined cases: documents are ordered by id, null ids last, then by a hash of id and
text.  A null text is the empty text.  Rows that repeat id and text are one document
and get the same result; texts that are equal under different ids are overlaps like any
other, of which all lines may go.  Lines differ by more than white space at their ends
or its amount between words.  Blank lines link nothing and go only inside a deleted
block.  An alignment costs the lines of the pair times a logarithm, so texts of any length
are aligned as a whole.  An empty table gives an empty result.  Columns of the input are packed in one
struct, so their names cannot clash.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.shared import BLANKS, stash, text_of

#: What one in so many rows belongs to is spread; so there are at most as many such keys.
SHARE = 1 << 12


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest part of pairs (sorted by the first number) in which the second rises."""
    tops: list[int] = []  # smallest last number of a part of each length
    at: list[int] = []
    before = [-1] * len(pairs)
    for n, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        before[n] = at[k - 1] if k else -1
        tops[k : k + 1], at[k : k + 1] = [b], [n]
    part, n = [], at[-1] if at else -1
    while n >= 0:
        part.append(pairs[n])
        n = before[n]
    return part[::-1]


def patience(a: list, b: list, words: list[int] | None = None, least_words: int = 10) -> list[tuple[int, int]]:
    """Aligned places (in a, in b), rising in both.  With ``words``, those of b's lines, gaps
    without unique lines are aligned on the runs that they share."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        place: dict[int, list[int]] = {}  # times in a, times in b, place in a, place in b
        for side, lines, start, end in ((0, a, a0, a1), (1, b, b0, b1)):
            for i in range(start, end):
                seen = place.setdefault(lines[i], [0, 0, 0, 0])
                seen[side] += 1
                seen[2 + side] = i
        anchors = increasing(sorted((i, j) for n, m, i, j in place.values() if n == m == 1))
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
            if anchors:
                todo.append((i + 1, k, j + 1, m))
        found += anchors
        if not anchors and words:
            found += [(i + a0, j + b0) for i, j in shared_runs(a[a0:a1], b[b0:b1], words[b0:b1], least_words, True)]
    return sorted(found)


def shared_runs(a: list, b: list, words: list[int], least_words: int, rising: bool) -> list[tuple[int, int]]:
    """Places of the runs of enough words that b shares with a, from b's first line on and as
    long as they go: each at its first place in a, behind those before it if ``rising``."""
    size, held, start = dict(zip(b, words, strict=True)), {}, 0
    for end in [*(i for i, x in enumerate(a) if x not in size), len(a)]:
        for i, j in runs([size[x] for x in a[start:end]], least_words):
            held.setdefault(tuple(a[start + i : start + j]), []).append(start + i)
        start = end + 1
    out, p, q = [], 0, 0
    for i, j in runs(words, least_words):
        if i < q:
            continue
        places = held.get(tuple(b[i:j]), [])
        k = bisect_left(places, p) if rising else 0
        if k < len(places):
            p, q = places[k], i
            while p < len(a) and q < len(b) and a[p] == b[q]:
                out.append((p, q))
                p, q = p + 1, q + 1
    return out


def runs(words: list[int], least_words: int) -> list[tuple[int, int]]:
    """Start and end of the shortest runs with enough words from and to each line with words."""
    at, least, out = [i for i, w in enumerate(words) if w], max(1, least_words), set()
    total, end = 0, 0
    for i in at:
        while end < len(at) and total < least:
            total, end = total + words[at[end]], end + 1
        if total < least:
            break
        out.add((i, at[end - 1] + 1))
        total -= words[i]
    total, start = 0, 0
    for i in at:
        total += words[i]
        while total - words[at[start]] >= least:
            total, start = total - words[at[start]], start + 1
        if total >= least:
            out.add((at[start], i + 1))
    return sorted(out)


def blocks(pairs: list[tuple[int, int]], words: list[int], least_words: int) -> list[int]:
    """Places in b of the aligned blocks that have enough words."""
    out, run = [], []
    for i, j in [*pairs, (-2, -2)]:
        if run and (i, j) != (run[-1][0] + 1, run[-1][1] + 1):
            if sum(words[m] for _, m in run) >= least_words:
                out += [m for _, m in run]
            run = []
        run.append((i, j))
    return out


def doomed(a: list, b: list, words: list[int], least_words: int) -> list[int]:
    """Places in b, the later document, that its alignments with a delete."""
    gone = blocks(patience(a, b, words, least_words), words, least_words)
    left = list(b)
    for place in gone:
        left[place] = (place,)  # equal to no other line
    more = shared_runs(a, left, [0 if isinstance(x, tuple) else w for x, w in zip(left, words, strict=True)], least_words, False)
    return sorted({*gone, *blocks(more, words, least_words)})


def _lines(docs: DataFrame, text: str, id: str) -> DataFrame:
    """key, id order, and hash and number of words of each line."""
    lines = F.split(text_of(text), "\n")
    words = F.transform(lines, lambda x: F.filter(F.split(x, BLANKS), lambda w: w != ""))
    df = docs.select(_key(text, id), F.col(id).cast("long").alias("doc_id"), words.alias("words"))
    df = df.select("key", F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key").alias("order"), F.transform("words", lambda w: F.xxhash64(F.array_join(w, " "))).alias("hashes"), F.transform("words", F.size).alias("sizes"))
    return df.dropDuplicates(["key"])


def _key(text: str, id: str):
    return F.xxhash64(F.col(id).cast("long"), text_of(text)).alias("key")


def _pairs(lines: DataFrame, least_words: int) -> DataFrame:
    """(later, earlier) keys of documents that share a run of enough words."""

    def run(batches):
        import xxhash

        for b in batches:
            found = []
            for x, w in zip(b.column("hashes").to_pylist(), b.column("sizes").to_pylist(), strict=True):
                x = np.array(x, np.int64)
                found.append(np.unique(np.array([xxhash.xxh64_intdigest(x[i:j].tobytes()) for i, j in runs(w, least_words)], np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("order"), pa.array(found, pa.list_(pa.int64()))], names=["key", "order", "runs"])

    each = stash(lines.mapInArrow(run, f"key long, order {lines.schema['order'].dataType.simpleString()}, runs array<long>").select("key", "order", F.explode("runs").alias("hash")), "runs")
    counted = each.groupBy("hash").agg(F.count("*").alias("holders"), F.min("order").alias("first")).where("holders > 1")
    shared = stash(counted.select("hash", "holders", F.col("first.key").alias("earlier")), "shared-runs")
    often = F.broadcast(shared.where(F.col("holders") > each.count() // SHARE))  # at most SHARE rows
    rest = each.join(often.select("hash"), "hash", "left_anti").join(shared.hint("merge"), "hash")
    held = each.join(often, "hash").select("key", "earlier").unionByName(rest.select("key", "earlier")).where("key <> earlier")
    return held.select(F.col("key").alias("later"), "earlier").distinct()


def deletions(docs: DataFrame, least_words: int = 10, text: str = "text", id: str = "doc_id") -> DataFrame:
    """key and deleted (sorted places of lines) of each document that loses lines."""
    lines = stash(_lines(docs, text, id), "lines")
    pairs = stash(_pairs(lines, least_words), "line-pairs")
    limit = pairs.count() // SHARE + 1
    met = pairs.groupBy("earlier").count().where(F.col("count") > limit)
    hubs = F.broadcast(met.select("earlier", F.ceil(F.col("count") / limit).cast("int").alias("parts")))  # at most SHARE rows
    part = F.pmod(F.xxhash64("later"), F.coalesce("parts", F.lit(1))).cast("int")
    pairs = pairs.join(hubs, "earlier", "left").select("later", "earlier", part.alias("part"))
    later = lines.select(F.col("key").alias("later"), F.col("hashes").alias("b"), F.col("sizes").alias("words"))
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
    earlier = lines.select(F.col("key").alias("earlier"), F.col("hashes").alias("a")).join(hubs, "earlier", "left").select("earlier", "a", copies)

    def run(batches):
        for b in batches:
            gone = [doomed(x, y, w, least_words) for x, y, w in zip(*(b.column(c).to_pylist() for c in ("a", "b", "words")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("later"), pa.array(gone, pa.list_(pa.int32()))], names=["key", "gone"])

    sides = pairs.join(later.hint("merge"), "later").join(earlier.hint("merge"), ["earlier", "part"])
    aligned = sides.select("later", "a", "b", "words").mapInArrow(run, "key long, gone array<int>")
    place = aligned.select("key", F.explode("gone").alias("place")).distinct()
    return place.groupBy("key").agg(F.sort_array(F.collect_list("place")).alias("deleted"))


def dedup_lines(docs: DataFrame, least_words: int = 10, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Each input row as ``row``, its remaining text, its number of lines and the
    places of the deleted ones."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    gone = stash(deletions(docs, least_words, text, id), "deletions")
    joined = docs.select(row, _key(text, id)).join(gone.hint("merge"), "key", "left").withColumn("lines", F.split(text_of(f"row.{text}"), "\n"))
    deleted = F.coalesce("deleted", F.array().cast("array<int>"))
    joined = joined.withColumn("deleted", deleted)
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "deleted")
    left = F.when(F.size("deleted") == 0, text_of(f"row.{text}")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    return joined.select("row", left.alias("text"), F.size("lines").alias("n_lines"), "deleted")
