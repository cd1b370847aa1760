"""Repair of the turn structure of conversations by A* on the lattice of edits.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``.  Rows may
be kept, given another role, deleted, or have empty rows put before them; blank and
repeated rows must go, and a truncated row costs extra while it stays.  A node of the
lattice is (rows read, state of the pattern).  The search pops nodes by (cost so far plus
the cost that the remaining rows can't avoid, audit so far), the latter from suffix sums
of mandatory deletions and truncation charges.  Two ways of one cost to one node never
are a prefix of each other, so the first one popped is the cheapest and of these the
least in ASCII, and each node is expanded once.

Scale: rows are dealt by ranges of their place, not by conversation, so a conversation
with a third of all rows lies in many tasks; repeated rows meet by the hash of their
text.  Blocks of ``BLOCK`` rows are searched each on their own, from every state of the
pattern to every other.  The fold over a conversation's blocks keeps four costs and
their order, as audits of different states always differ before their ends.  Last,
texts stream through the task of their conversation in order, in batches, past its audit;
that pass is one chain for each conversation because its result is one hash or one
sequence, and it holds nothing but the audit.

Defined cases: a null role or text is one space, so a null text is blank; null ids form
one conversation.  Rows come by turn, nulls first, and those of one turn by role and hash
of their text.  A role of other initials can't be kept.  A conversation without rows
needs no edit.  An empty table gives an empty result.  Very long texts are hashed and
compared by hash; other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidegauge.llm.shared import partitions, slices, stash

#: Prices of the edits and the charge of a truncated row that stays (fixed values of the contract).
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: Rows of a block; a power of two.
BLOCK = 512
#: States: nothing yet, after s, after u, after a.  What each letter leads to, and the letter that an edit can add.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
ADDS, ROLES, ENDS = ("u", "u", "a", "u"), {"u": "user", "a": "assistant"}, (0, 3)
#: Inserts that complete the pattern from each state.
CLOSING = ("", "II", "I", "")
BLANK = " \t\n\x0b\x0c\r"

#: Each row in the search: d must go; s, u, a or x (another initial), upper case if truncated.
FLOOR = {"d": DELETE, **dict.fromkeys("suax", 0), **dict.fromkeys("SUAX", TRUNCATED)}


@lru_cache(1 << 15)
def search(codes: str, start: int, whole: bool) -> tuple[tuple[int, int, str], ...]:
    """(end state, cost, audit) of the cheapest edits of rows from one state: to the best
    end of the pattern if they are the ``whole`` rest, else to each state, with the last
    edit at the last row."""
    n = len(codes)
    least = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        least[i] = least[i + 1] + FLOOR[codes[i]]
    heap, done, ends = [(least[0], "", 0, start)], set(), []
    while heap:
        f, audit, i, q = heappop(heap)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == n and (q in ENDS or not whole):
            ends.append((q, f, audit))
            if whole:
                break
        if i == n and not whole:
            continue
        paid, added = f - least[i], STEP[q, ADDS[q]]
        heappush(heap, (f + INSERT, audit + "I", i, added))
        if i < n:
            paid, code = paid + least[i + 1], codes[i]
            heappush(heap, (paid + DELETE, audit + "D", i + 1, q))
            if code != "d":
                charge = TRUNCATED * code.isupper()
                heappush(heap, (paid + charge + REROLE, audit + "R", i + 1, added))
                if (kept := STEP.get((q, code.lower()))) is not None:
                    heappush(heap, (paid + charge, audit + "K", i + 1, kept))
    return tuple(ends)


LEGAL = {"su", "ua", "au"}
WAY = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())])
FOUND = T.StructType([T.StructField("illegal", T.LongType()), T.StructField("ways", T.ArrayType(WAY))])
WAYS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


@F.arrow_udf(FOUND)
def searched(codes: pa.Array, initials: pa.Array, alone: pa.Array, opening: pa.Array) -> pa.Array:
    illegal, ways = [], []
    for code, initial, whole, first in zip(codes.to_pylist(), initials.to_pylist(), alone.to_pylist(), opening.to_pylist(), strict=True):
        illegal.append(sum(initial[i : i + 2] not in LEGAL for i in range(len(initial) - 1)))
        ways.append([{"start": q, "end": e, "cost": cost, "audit": audit} for q in ((0,) if first else range(4)) for e, cost, audit in search(code, q, whole)])
    return pa.StructArray.from_arrays([pa.array(illegal, pa.int64()), pa.array(ways, WAYS)], names=["illegal", "ways"])


class Fold:
    """The blocks of a conversation, taken in order."""

    def __init__(self):
        self.gaps = self.blank = self.duplicate = self.truncated = self.illegal = self.blocks = 0
        self.turns, self.last, self.low, self.high = 0, None, None, None
        #: State -> (cost, audit as a chain of blocks' pieces), the least audit first.
        self.alive: dict[int, tuple[int, tuple | None]] = {0: (0, None)}
        self.whole: tuple[int, str] | None = None

    def add(self, block: dict) -> None:
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + block[name])
        if self.blocks and self.last + block["initials"][0] not in LEGAL:
            self.illegal += 1
        self.blocks, self.last = self.blocks + 1, block["initials"][-1]
        if block["turns"]:
            self.turns += block["turns"] - (self.high == block["low"])
            self.low, self.high = block["low"] if self.low is None else self.low, block["high"]
        if block["alone"]:
            (way,) = block["ways"]
            self.whole = way["cost"], way["audit"]
            return
        rank, best = {q: k for k, q in enumerate(self.alive)}, {}
        for way in block["ways"]:
            if (q := way["start"]) in rank:
                cost, before = self.alive[q]
                key = cost + way["cost"], rank[q], way["audit"]
                if way["end"] not in best or key < best[way["end"]][0]:
                    best[way["end"]] = key, (before, way["audit"])
        self.alive = {q: (key[0], chain) for q, (key, chain) in sorted(best.items(), key=lambda x: x[1][0][1:])}

    def done(self) -> tuple[int, str]:
        """Cost and audit of the conversation."""
        if self.whole:
            return self.whole
        ends = [(cost + INSERT * len(CLOSING[q]), rank, q, chain) for rank, (q, (cost, chain)) in enumerate(self.alive.items())]
        cost, _, q, chain = min(ends, key=lambda x: x[:2])
        pieces = [CLOSING[q]]
        while chain:
            chain, piece = chain
            pieces.append(piece)
        return cost, "".join(reversed(pieces))

    def missing(self) -> int:
        return self.high - self.low + 1 - self.turns if self.turns else 0


class Lines:
    """A conversation's rows, edited one by one."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _added(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            letter = ADDS[self.state]
            self.state, self.at = STEP[self.state, letter], self.at + 1
            yield ROLES[letter], "", "I"

    def take(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(role, text, edit) of what stands before and instead of the next row."""
        yield from self._added()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit != "D":
            letter = role[0] if edit == "K" else ADDS[self.state]
            self.state = STEP[self.state, letter]
            yield role if edit == "K" else ROLES[letter], text, edit

    def rest(self) -> Iterator[tuple[str, str, str]]:
        yield from self._added()


def walked(batches) -> Iterator[tuple[object, Fold | None, tuple[str, str, str] | None]]:
    """(conversation, None, line) for each repaired line and (conversation, its fold,
    None) after the last one.  Rows: a head of each conversation, its blocks, its rows."""
    name, fold, lines = None, None, None

    def closed():
        lines_ = lines or Lines(fold.done()[1])
        for line in lines_.rest():
            yield name, None, line
        yield name, fold, None

    for whole in batches:
        for b in slices(whole, "text"):
            columns = {c: b.column(c).to_pylist() for c in b.schema.names}
            for id, kind, block, role, text in zip(*[columns[c] for c in ("conv_id", "kind", "block", "role", "text")], strict=True):
                if kind == 0:
                    if fold:
                        yield from closed()
                    name, fold, lines = id, Fold(), None
                elif kind == 1:
                    fold.add(block)
                else:
                    lines = lines or Lines(fold.done()[1])
                    for line in lines.take(role, text):
                        yield name, None, line
    if fold:
        yield from closed()


def ordered_rows(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role and text; nulls of the last two are one space."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), some(role).alias("role"), some(text).alias("text"))


def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows of which some, by the hash of conversation and turn, are lost, emptied, without
    sentence ends, repeated or the user's."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(some(conv_id), F.lit(":"), some(turn)).cast("binary")) % 20
    plain = rows.select(kind.alias("kind"), F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), some(role).alias("role"), some(text).alias("text")).where("kind <> 0")
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return plain.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), times.alias("copy")).drop("copy")


#: Ascending order has nulls first.
PLACE = ("conv_id", "turn", "role", "digest")


def _blocks(rows: DataFrame) -> DataFrame:
    """Blocks of ``BLOCK`` rows in order, searched: conv_id, block and what it found."""
    end = F.substring(F.rtrim("text", F.lit(BLANK)), -1, 1)
    fault = F.when(end == "", "blank").when(~end.isin(".", "!", "?"), "truncated")
    initial = F.substring("role", 1, 1)
    light = rows.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), fault.alias("fault"), F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"), F.monotonically_increasing_id().alias("n"))
    # Places follow the ranges, so equal rows in any number are spread as well.
    dealt = light.repartitionByRange(partitions(rows.sparkSession), *PLACE, "n").sortWithinPartitions(*PLACE, "n")
    placed = stash(dealt.withColumn("place", F.monotonically_increasing_id()).drop("n"), "turns")
    first = placed.groupBy("conv_id", "role", "digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    known = placed.join(first, "place", "left")
    fault = F.when(F.col("fault") == "blank", "blank").when(F.col("first").isNull(), "duplicate").otherwise(F.col("fault"))
    named = known.select("conv_id", F.shiftright("place", BLOCK.bit_length() - 1).alias("block"), "place", "turn", "initial", fault.alias("fault"))
    code = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    sums = [F.count_if(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")]
    held = named.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("place", "turn", "initial", code.alias("code")))).alias("rows"), *sums)
    text = lambda c: F.array_join(F.transform("rows", lambda x: x[c]), "")
    turns = F.array_distinct(F.filter(F.transform("rows", lambda x: x["turn"]), lambda t: t.isNotNull()))
    cut = held.select("conv_id", "block", "blank", "duplicate", "truncated", text("initial").alias("initials"), text("code").alias("codes"), F.size(turns).alias("turns"), F.array_min(turns).alias("low"), F.array_max(turns).alias("high"))
    mine = Window.partitionBy("conv_id")
    counted = cut.withColumns({"alone": F.count("*").over(mine) == 1, "opening": F.col("block") == F.min("block").over(mine)})
    # A long conversation's blocks are searched in many tasks.
    found = counted.repartition(partitions(rows.sparkSession), "conv_id", "block").withColumn("found", searched("codes", "initials", "alone", "opening"))
    return found.select("conv_id", "block", F.struct("blank", "duplicate", "truncated", "initials", "turns", "low", "high", "alone", "found.illegal", "found.ways").alias("held"))


def _streams(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """Heads, blocks and rows of each conversation, one after the other in a partition."""
    blocks = _blocks(rows)
    nothing = lambda df, **kinds: df.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items()})
    texts = {"turn": "long", "role": "string", "digest": "binary", "text": "string"}
    shape = blocks.schema["held"].dataType.simpleString()
    heads = nothing(ids.select("conv_id", F.lit(0).alias("kind")).distinct(), number="long", block=shape, **texts)
    middle = nothing(blocks.select("conv_id", F.lit(1).alias("kind"), F.col("block").alias("number"), F.col("held").alias("block")), **texts)
    tail = nothing(rows.select("conv_id", F.lit(2).alias("kind"), "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), "text"), number="long", block=shape)
    every = heads.unionByName(middle).unionByName(tail)
    dealt = every.repartition(partitions(rows.sparkSession), "conv_id")
    return dealt.sortWithinPartitions("conv_id", "kind", "number", *PLACE[1:]).select("conv_id", "kind", "block", "role", "text")


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit) of every line of the repaired conversations;
    ``rows``: conv_id, turn, role and text, as ``ordered_rows`` gives them."""
    kind, id_type = rows.schema["conv_id"].dataType.simpleString(), to_arrow_type(rows.schema["conv_id"].dataType)

    def run(batches):
        out, place, size = [], 0, 0
        for id, fold, line in walked(batches):
            if fold:
                place = 0
                continue
            out.append((id, place, *line))
            place, size = place + 1, size + len(line[1]) + 64
            if size > 1 << 21:
                yield from _batches(out)
                out, size = [], 0
        yield from _batches(out)

    names = ["conv_id", "place", "role", "text", "edit"]
    types = [pa.field("place", pa.int64()), *[pa.field(n, pa.string()) for n in names[2:]]]

    def _batches(out):
        if out:
            ids, *rest = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), *[pa.array(v, f.type) for v, f in zip(rest, types, strict=True)]], names=names)

    return _streams(rows, rows).mapInArrow(run, f"conv_id {kind}, place long, role string, text string, edit string")


SUMMARY = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def audit(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """A row for each conversation of ``ids``: gaps in its turns, faults, illegal
    neighbours, cost and audit of its repair, and the SHA-256 of the repaired
    ``role:text`` lines."""
    kind, id_type = rows.schema["conv_id"].dataType.simpleString(), to_arrow_type(rows.schema["conv_id"].dataType)

    def run(batches):
        out, hashed, begun = [], hashlib.sha256(), False
        for id, fold, line in walked(batches):
            if line:
                hashed.update(f"{chr(10) * begun}{line[0]}:{line[1]}".encode())
                begun = True
                continue
            cost, edits = fold.done()
            out.append((id, fold.missing(), fold.blank, fold.duplicate, fold.truncated, fold.illegal, cost, edits, hashed.hexdigest()))
            hashed, begun = hashlib.sha256(), False
            if len(out) >= 4096:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    def _batch(out):
        ids_, *rest = zip(*out, strict=True)
        kinds = [*[pa.int64()] * len(SUMMARY), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(ids_, id_type), *[pa.array(v, t) for v, t in zip(rest, kinds, strict=True)]], names=["conv_id", *SUMMARY, "audit", "repaired_sha256"])

    shape = ", ".join(f"{c} long" for c in SUMMARY)
    return _streams(ids, rows).mapInArrow(run, f"conv_id {kind}, {shape}, audit string, repaired_sha256 string")
