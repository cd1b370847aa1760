"""Links between texts by exact Jaccard similarity of word shingles.

Two texts are linked if at least 4/5 of all their distinct shingles are in both.  A
fingerprint of 64 bits can't tell that (see ``simhash``), so candidates come from the
sets of shingles, without loss:

* All sets are ordered alike: by hash, except that shingles of at least one row in
  ``SHARE`` come last.  Two sets of that similarity have a shingle in common among the
  first n - ceil(4n/5) + 1 of each, which are their keys.
* A set's mask has a bit for each class of hashes, set where the set has an odd number of
  them.  There are at least four times as many classes as shingles, a power of two and
  ``BITS`` at least; a longer mask folds to a shorter one.  Masks differ in no more bits than sets
  do in shingles, and similar sets of a and b shingles in at most (a + b) / 9.

Links that another method proposes (``simhash`` those of its fingerprints) are confirmed first.
Without them a row is first compared with one other, the smallest that shares a key with it.
Components are found; then, while that finds links, with one member of each of its buckets that is in
another component, chosen anew each time.  Then each bucket gives, for each two components
that it has members of, the pair whose masks differ least; and at last all members of one
bucket that are still in different components are compared with each other.  Sizes and masks must allow it each time, and a crowded bucket is dealt in groups
of bounded size.  So a large group of near copies costs no pairs.

Shingles are known by 64-bit hashes.  Which shingles are ordered last changes the work,
never the result.  Defined cases: words are split and lower-cased as bytes; a text of
fewer words than a shingle is one shingle; null and wordless texts are equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.components import components
from tidegauge.llm.language_model import mixed
from tidegauge.llm.shared import drop, frugal, recorded, release, slices, stash, text_of

WORDS, SEED, BITS = 5, 42, 1024
#: A shingle in one of so many rows is frequent; their number is at most this times the mean number of shingles, and ``FREQUENT``.
SHARE, FREQUENT = 500, 1 << 18
#: Shingles counted together, in how many rows of those one must be to be reported, and members of a group of a crowded bucket.
TOGETHER, REPORTED, GROUP = 1 << 21, 8, 1024
#: Rounds of comparisons with one member of a bucket at most, and links for each row that the next one needs.
ROUNDS, WORTH = 2, 0.01
NO_ONE = np.empty(0, np.uint64)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    import xxhash

    found = text.encode().lower().split()
    digest = xxhash.xxh64_intdigest
    of = np.array([digest(w, SEED) for w in found], np.uint64)
    if not len(of):
        return of
    n = min(words, len(of))
    out = of[: len(of) - n + 1]
    for k in range(1, n):
        out = mixed(out, of[k : len(of) - n + 1 + k], k)
    return np.unique(mixed(out, out, n + words))


def keys(found: np.ndarray, frequent: tuple[np.ndarray, np.ndarray] = (NO_ONE, NO_ONE)) -> np.ndarray:
    """The first shingles of a set, one of which every similar set has among its own.

    ``frequent``: the sorted frequent shingles, and the place of each among them.
    """
    if not len(found):
        return np.zeros(1, np.uint64)
    first = len(found) - -(-4 * len(found) // 5) + 1
    hashes, place = frequent
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
        last = hashes[at] == found
        if last[:first].any():
            late = found[last][np.argsort(place[at[last]], kind="stable")]
            return np.concatenate([found[~last], late])[:first]
    return found[:first]


def mask(found: np.ndarray) -> np.ndarray:
    bits = max(BITS, 1 << (4 * len(found)).bit_length())
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def folded(masks: np.ndarray, length: int) -> np.ndarray:
    """Masks (rows) of a power of two times ``length`` as they are with that length."""
    while masks.shape[-1] > length:
        masks = masks[..., : masks.shape[-1] // 2] ^ masks[..., masks.shape[-1] // 2 :]
    return masks


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def numbered(docs: DataFrame, text: str, id: str) -> DataFrame:
    """Written: rid (a number for each row), doc_id and row."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return stash(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id).cast("long").alias("doc_id"), row), "numbered")


def _frequent(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of at least one row in ``SHARE``, rarer ones first, as ``keys`` takes them."""

    @frugal
    def run(batches):
        held, size = [], 0

        def report():
            least = max(REPORTED, len(held) // SHARE)  # as many in all tasks together as in one of them
            every = np.concatenate(held)
            held.clear()
            every.sort()
            many = np.unique(every[least - 1 :][every[least - 1 :] == every[: max(0, len(every) - least + 1)]])
            n = np.searchsorted(every, many, "right") - np.searchsorted(every, many)
            return pa.RecordBatch.from_arrays([pa.array(many.view(np.int64)), pa.array(n)], names=["hash", "n"])

        for b in batches:
            for part in slices(b, "text"):
                for t in part.column("text").to_pylist():
                    held.append(shingles(t, words))
                    size += len(held[-1])
                    if size >= TOGETHER:
                        yield report()
                        size = 0
        if held:
            yield report()

    counted = rows.mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    found = counted.where(F.col("n") * SHARE >= rows.count()).orderBy(F.desc("n"), "hash").limit(FREQUENT).toArrow()
    hashes, n = found.column("hash").to_numpy().view(np.uint64), found.column("n").to_numpy()
    by_hash, place = np.argsort(hashes), np.empty(len(hashes), np.int64)
    place[np.lexsort((hashes, n))] = np.arange(len(hashes))
    return hashes[by_hash], place[by_hash]


def _keyed(rows: DataFrame, words: int) -> DataFrame:
    """Written: rid, size, mask and keys of each row."""
    frequent = rows.sparkSession.sparkContext.broadcast(_frequent(rows, words))

    @frugal
    def run(batches):
        for part in (part for b in batches for part in slices(b, "text")):
            found = [shingles(t, words) for t in part.column("text").to_pylist()]
            if found:
                each = [keys(f, frequent.value) for f in found]
                end = np.cumsum([0, *map(len, each)]).astype(np.int32)
                masks = [mask(f) for f in found]
                masks = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, masks)]).astype(np.int32)), pa.array(np.concatenate(masks)))
                yield pa.RecordBatch.from_arrays([part.column("rid"), pa.array([len(f) for f in found], pa.int32()), masks, pa.ListArray.from_arrays(pa.array(end), pa.array(np.concatenate(each).view(np.int64)))], names=["rid", "size", "mask", "keys"])

    return stash(rows.mapInArrow(run, "rid long, size int, mask array<long>, keys array<long>"), "keys")


def _confirmed(pairs: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """Written: those of pairs (a, b) that are similar."""

    @frugal
    def sets(batches):
        for part in (part for b in batches for part in slices(b, "text")):
            found = [shingles(t, words).view(np.int64) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("rid"), pa.array(found, pa.list_(pa.int64()))], names=["rid", "found"])

    @frugal
    def run(batches):
        for b in batches:
            x, y = b.column("x"), b.column("y")
            good = [similar(np.array(x[i].values), np.array(y[i].values)) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    spark = rows.sparkSession
    with recorded(made := []):
        pairs = stash(pairs, "candidates")
        named = stash(pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).distinct(), "named")
        release(spark)
        # Spark knows the size of a written table, so for few rows texts are not shuffled.
        held = stash(rows.join(named, "rid").mapInArrow(sets, "rid long, found array<long>"), "shingles")
    sides = pairs.join(held.toDF("a", "x").hint("merge"), "a").join(held.toDF("b", "y").hint("merge"), "b")
    found = stash(sides.mapInArrow(run, "a long, b long"), "similar")
    drop(spark, made)
    release(spark)
    return found


def _may_be_similar(size: Column, other: Column, own: Column, its: Column) -> Column:
    """Whether sizes and masks allow the similarity."""
    short = F.least(F.size(own), F.size(its))  # of similar sets the one is as long, or twice
    fold = lambda m: F.when(F.size(m) > short, F.zip_with(F.slice(m, 1, short), F.slice(m, short + 1, short), lambda x, y: x.bitwiseXOR(y))).otherwise(m)
    differing = F.aggregate(F.zip_with(fold(own), fold(its), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.when(5 * F.least(size, other) >= 4 * F.greatest(size, other), 9 * differing <= size + other).otherwise(False)


def _pairs(m: pa.Array, lo: int, hi: int, closest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members of a group in different components that may be similar; with
    ``closest`` only the best for each two components."""
    rid, root, size, part = (np.array(m.field(f)) for f in ("rid", "root", "size", "part"))
    masks = [np.asarray(x.values).view(np.uint64) for x in m.field("mask")]
    length = np.array([len(x) for x in masks])
    level = {n: np.stack([folded(x, n) if len(x) <= 2 * n else x[:n] for x in masks if len(x) >= n]) for n in np.unique(length).tolist()}
    place = {n: np.cumsum(length >= n) - 1 for n in level}
    found = [np.empty((3, 0), np.int64)]
    for i in np.flatnonzero(part == lo).tolist():
        fit = (root != root[i]) & (part == hi) & ((rid > rid[i]) | (lo != hi)) & (5 * np.minimum(size, size[i]) >= 4 * np.maximum(size, size[i]))
        # Of the others that are long enough some have longer masks, some have shorter ones.
        for n in {int(length[i]), int(length[i]) // 2} & level.keys():
            other = np.flatnonzero(fit & (length >= n if n == length[i] else length == n))
            if len(other):
                differing = np.bitwise_count(level[n][place[n][other]] ^ folded(masks[i], n)).sum(axis=1, dtype=np.int64)
                good = 9 * differing <= size[other] + size[i]
                other = other[good]
                found.append(np.stack([np.full(len(other), i), other, (1 << 20) * differing[good] // np.maximum(1, size[other] + size[i])]))
    i, j, far = np.concatenate(found, axis=1)
    if closest:
        two = np.stack([np.minimum(root[i], root[j]), np.maximum(root[i], root[j])], axis=1)
        order = np.lexsort((far, two[:, 1], two[:, 0]))
        first = np.append(True, (two[order][1:] != two[order][:-1]).any(axis=1))[: len(order)]
        i, j = i[order][first], j[order][first]
    return np.minimum(rid[i], rid[j]), np.maximum(rid[i], rid[j])


def _apart(closest: bool):
    @frugal
    def run(batches):
        for b in batches:
            found = [_pairs(m.values, lo, hi, closest) for m, lo, hi in zip(b.column("members"), b.column("lo").to_pylist(), b.column("hi").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found] or [np.empty(0, np.int64)])) for k in (0, 1)], names=["a", "b"])

    return run


def links(rows: DataFrame, words: int = WORDS, proposed: DataFrame | None = None) -> DataFrame:
    """Links (a, b) that connect all similar texts (rid, text).

    ``proposed`` links (a, b) are confirmed first; then only texts that these leave
    apart are compared.
    """
    with recorded(made := []):
        keyed = _keyed(rows, words)
    each = keyed.select("rid", F.explode("keys").alias("key"))
    members = [F.bit_xor(F.xxhash64("rid", F.lit(seed))).alias(f"x{seed}") for seed in (0, 1)]
    met = each.groupBy("key").agg(F.count("*").alias("n"), F.min("rid").alias("hub"), *members).where("n > 1")
    # Of buckets with the same members (told by 128 bits) one is enough.
    met = stash(met.groupBy("n", "hub", "x0", "x1").agg(F.min("key").alias("key")).select("key", "n", "hub"), "buckets")
    held = stash(each.join(met.hint("merge"), "key"), "members")
    known = stash(keyed.select("rid", "size", "mask"), "masks")
    drop(rows.sparkSession, made)  # keys take more room than masks and are in the members
    release(rows.sparkSession)

    def confirmed(pairs: DataFrame) -> DataFrame:
        sides = pairs.join(known.toDF("a", "size_a", "mask_a").hint("merge"), "a").join(known.toDF("b", "size_b", "mask_b").hint("merge"), "b")
        return _confirmed(sides.where(_may_be_similar(F.col("size_a"), F.col("size_b"), F.col("mask_a"), F.col("mask_b"))).select("a", "b"), rows, words)

    def split(near: DataFrame, turn: int) -> DataFrame:
        """Written: members, with their roots, of buckets with several roots; and a member of the bucket with its root."""
        of = components(near)
        rooted = stash(held.join(of.toDF("rid", "root").hint("merge"), "rid", "left").withColumn("root", F.coalesce("root", "rid")), "rooted")
        chosen = F.min_by(F.struct("rid", "root"), F.xxhash64("rid", F.lit(turn))).alias("hub")
        roots = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), chosen).where("least < most")
        found = stash(rooted.join(roots.select("key", "hub").hint("merge"), "key"), "apart")
        release(rows.sparkSession)
        return found

    if proposed is None:
        proposed = held.groupBy("rid").agg(F.min("hub").alias("a")).where("a < rid").select("a", F.col("rid").alias("b"))
    near = confirmed(proposed)
    held, every = held.select("key", "n", "rid"), rows.count()
    apart = split(near, 0)
    for turn in range(1, ROUNDS + 1):
        pairs = apart.where("root <> hub.root").select(F.least("rid", "hub.rid").alias("a"), F.greatest("rid", "hub.rid").alias("b")).distinct()
        more = confirmed(stash(pairs, "hub-pairs"))
        found = more.count()
        if found:
            near = stash(near.union(more), "near")
            apart = split(near, turn)
        if found <= WORTH * every:
            break

    def searched(apart: DataFrame, closest: bool) -> DataFrame:
        parts = F.ceil(F.col("n") / GROUP).cast("int")
        member = apart.where("n > 2").select("key", "rid", "root", parts.alias("parts")).join(known.hint("merge"), "rid")
        member = member.withColumn("part", F.pmod(F.xxhash64("rid"), "parts").cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        grouped = member.groupBy("key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi")).agg(F.collect_list(F.struct("rid", "root", "size", "mask", "part")).alias("members"))
        return _confirmed(grouped.select("members", "lo", "hi").mapInArrow(_apart(closest), "a long, b long").distinct(), rows, words)

    near = stash(near.union(searched(apart, True)), "near")
    return near.union(searched(split(near, 0), False))


def keep_first(rows: DataFrame, links: DataFrame) -> DataFrame:
    """The row with the smallest id of each component of ``links``, null ids last."""
    stars = components(links)
    member = stars.union(stars.select("root", "root").distinct()).toDF("rid", "root").join(rows.select("rid", "doc_id"), "rid")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "rid")
    first = member.groupBy("root").agg(F.min(order)["rid"].alias("rid")).select("rid")
    gone = stash(member.select("rid").join(first, "rid", "left_anti"), "near-copies")
    return rows.join(gone, "rid", "left_anti").select("row.*")


def keep_one(docs: DataFrame, words: int = WORDS, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The row with the smallest id of each component, null ids last, with all columns of ``docs``."""
    rows = numbered(docs, text, id)
    return keep_first(rows, links(rows.select("rid", text_of(f"row.{text}").alias("text")), words))
