"""Packing documents into sequences: dominance reduction, then best fit.

How full sequences can get depends only on how many pieces there are of each
length, and there are at most ``capacity`` lengths.  So the plan is made on that
table of counts, whatever the number of documents:

1. Martello-Toth reduction: a longest piece together with one or two others is
   fixed for good where that set provably dominates every other set that could
   share the longest piece's sequence (each of those pieces fits in the place of
   one of the set's).  Taking pieces away only takes alternatives away, so the
   step repeats for as many sequences as the counts allow at once.
2. Best fit decreasing on what is left, for groups of equal sequences at a time.

The plan is a list of patterns (so many sequences holding these lengths); there are
at most a few for each length, and each has few distinct lengths.  Every
piece is then numbered among those of its length, and its number leads to its place.

Defined cases: a null text is the empty text and becomes the single id 0.  A
document of up to ``capacity`` ids is one piece; a longer one is cut into pieces of
``capacity`` ids, the last of which may be shorter.  Repeated rows are packed each
for itself.  An empty table gives an empty result.  Other columns of the input are
neither read nor returned.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.bpe import Merger, Ragged, spread
from tidegauge.llm.shared import frugal, kept_here, slices, stash, text_of

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, pid int, nth long, row_id long"
#: Bytes tokenised at a time, and parts of words remembered by a Python worker.
BLOCK, REMEMBERED = 1 << 20, 1 << 18
#: Pre-tokens of the word vocabulary (a fixed value), and those of them that begin with its apostrophe.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SHORT_FORMS = tuple(x.encode() for x in WORD.split("|") if x[0] == "'")
#: Bytes that tell parts apart in two numbers.
WIDE = 16
#: Kinds of bytes.  Those of one kind in a row are one part, from ALONE on each for itself; a word
#: with anything ODD, where normal forms or other character classes matter, is one part.
SPACE, LETTER, OTHER, ODD, DIGIT, END = range(6)
ALONE = DIGIT
GOLDEN = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
#: The bytes that count of eight, by how many there are.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


@lru_cache(maxsize=1)
def alphabet() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Kind and lower case of each byte below 0x80, and of each character of two bytes
    (lower case as its two bytes).  Plain are visible ASCII and U+00A1 to U+024F, where lower
    case does not depend on the letters around, as far as it has two bytes as well."""
    import regex

    is_letter, is_number = regex.compile(r"\p{L}").match, regex.compile(r"\p{N}").match
    kind, lower = np.full(256, ODD, np.uint8), np.arange(256, dtype=np.uint8)
    kind2, lower2 = np.full(0x800, ODD, np.uint8), np.zeros((0x800, 2), np.uint8)
    kind[[0x20, *range(9, 14)]] = SPACE
    for code in [*range(0x21, 0x7F), *range(0xA1, 0x250)]:
        low = chr(code).lower()
        what = LETTER if is_letter(low) else DIGIT if is_number(low) else OTHER
        if code < 0x80:
            kind[code], lower[code] = what, ord(low)
        elif len(low) == 1 and len(low.encode()) == 2 and what != DIGIT:
            kind2[code], lower2[code] = what, list(low.encode())
    return kind, lower, kind2, lower2


def keys(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of words of up to ``WIDE`` bytes, none of them zero, as two numbers."""
    padded = np.append(raw, np.zeros(WIDE, np.uint8))
    eight = np.ndarray(len(raw) + 8, "<u8", padded, strides=(1,))
    first, second = eight[start] & MASKS[np.minimum(size, 8)], np.zeros(len(start), np.uint64)
    more = np.flatnonzero(size > 8)
    second[more] = eight[start[more] + 8] & MASKS[size[more] - 8]
    return first, second


def grouped(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One word of each kind among ``raw[start:end]``, of up to ``WIDE`` bytes each, and the kind of each word."""
    one, two = keys(raw, start, end - start)
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    new = np.ones(len(order), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    return order[new], kind


class Known:
    """Rows of known parts of up to ``WIDE`` bytes, in an open-addressed table that grows.

    The table holds rows only; what they are lies in the order in which they came, so
    the frequent ones, which come early, lie side by side.
    """

    def __init__(self):
        self.rows, self.used = np.full(1 << 12, -1, np.int32), 0
        self.one, self.two = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.uint64)

    def _home(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        mixed = one * GOLDEN[0] ^ two * GOLDEN[1]
        mixed = (mixed ^ mixed >> np.uint64(32)) * GOLDEN[0]
        return (mixed >> np.uint64(65 - len(self.rows).bit_length())).astype(np.int64)

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Row of each, -1 for unknown ones."""
        at, last = self._home(one, two), len(self.rows) - 1
        found = self.rows[at]
        open_ = np.flatnonzero((found >= 0) & ((self.one[found] != one) | (self.two[found] != two)))
        while len(open_):
            at[open_] = (at[open_] + 1) & last
            found[open_] = here = self.rows[at[open_]]
            open_ = open_[(here >= 0) & ((self.one[here] != one[open_]) | (self.two[here] != two[open_]))]
        return found

    def add(self, one: np.ndarray, two: np.ndarray, first_row: int) -> None:
        """New and different ones get the rows from ``first_row`` on."""
        rows = np.arange(first_row, first_row + len(one), dtype=np.int32)
        while first_row + len(one) > len(self.one):
            self.one, self.two = (np.append(x, np.zeros_like(x)) for x in (self.one, self.two))
        self.one[rows], self.two[rows] = one, two
        self.used += len(one)
        if 3 * self.used > len(self.rows):
            rows = np.append(self.rows[self.rows >= 0], rows)
            self.rows = np.full(1 << (4 * self.used).bit_length(), -1, np.int32)
        at = self._home(self.one[rows], self.two[rows])
        while len(rows):
            free = self.rows[at] < 0
            self.rows[at[free]] = rows[free]
            rest = self.rows[at] != rows  # also where another one took the place
            rows, at = rows[rest], (at[rest] + 1) & (len(self.rows) - 1)


class WordIds:
    """Ids of the parts of words, remembered as rows of a ragged table.

    Parts of plain Latin letters, digits and signs are found, told apart and merged on
    arrays of bytes, all new ones of a block together; words with any other character
    go through the tokenizers library.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.library, self.merger = Tokenizer.from_file(path), Merger(path)
        self.special = [x.encode() for x in self.merger.special]
        self.remembered = remembered
        self.forget()

    def forget(self) -> None:
        """Only the end of a document is known, which is the id 0."""
        self.known, self.named, self.ids = Known(), {}, Ragged()
        self.ids.add(np.zeros(1, np.int32), np.ones(1, np.int64))

    def parts(self, block: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The block in lower case (odd words as they are), and start, size and kind of its parts."""
        kinds, lower, kinds2, lower2 = alphabet()
        raw = np.frombuffer(block, np.uint8)
        kind, low = kinds[raw], lower[raw]
        if not block.isascii():
            lead = np.flatnonzero((raw >= 0xC2) & (raw <= 0xDF))
            code = (raw[lead].astype(np.int64) & 0x1F) << 6 | raw[lead + 1] & 0x3F
            kind[lead] = kind[lead + 1] = kinds2[code]
            plain = kinds2[code] != ODD
            lead = lead[plain]
            low[lead], low[lead + 1] = lower2[code[plain]].T
        for x in self.special:
            at = block.find(x)
            while at >= 0:
                kind[at] = ODD
                at = block.find(x, at + 1)
        kind[ends] = END
        odd = np.flatnonzero(kind == ODD)
        if len(odd):
            breaks = np.flatnonzero((kind == SPACE) | (kind == END))
            after = np.unique(np.searchsorted(breaks, odd))
            begin = np.where(after > 0, breaks[after - 1] + 1, 0)
            odd = spread(begin, np.append(breaks, len(raw))[after] - begin)
            kind[odd], low[odd] = ODD, raw[odd]
        edge = kind >= ALONE
        edge[:1] = True
        edge[1:] |= kind[1:] != kind[:-1]
        signs = np.flatnonzero((low == ord("'")) & edge & (kind == OTHER))
        if len(signs):
            next_ = np.append(low, np.zeros(3, np.uint8))
            for form in SHORT_FORMS:
                some = signs[np.logical_and.reduce([next_[signs + k] == c for k, c in enumerate(form)])]
                edge[some + 1] = False
                past = some + len(form)
                past = past[past < len(raw)]
                edge[past[kind[past] == LETTER]] = True
        start = np.flatnonzero(edge)
        size = np.diff(start, append=len(raw))
        some = np.flatnonzero(kind[start] != SPACE)
        start, size = start[some], size[some]
        return low, start, size, kind[start]

    def of(self, block: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words of a block, and how many each line has; ``ends`` are the places of the
        bytes that end a line, which have the id 0.  The block ends with the end of a word."""
        if self.ids.rows > self.remembered:
            self.forget()
        low, start, size, kind = self.parts(block, ends)
        rows = np.zeros(len(start), np.int64)
        short = np.flatnonzero((kind != END) & (kind != ODD) & (size <= WIDE))
        rows[short] = self.short(low, start[short], size[short])
        rest = np.flatnonzero((kind == ODD) | (size > WIDE))
        if len(rest):
            rows[rest] = self.others(low, start[rest], size[rest], kind[rest])
        ids, count = self.ids.take(rows)
        until = np.append(0, np.cumsum(count))[np.append(np.flatnonzero(kind == END) + 1, len(count))]
        return ids, np.diff(until, prepend=0)

    def short(self, low: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Rows of plain parts of up to ``WIDE`` bytes."""
        one, two = keys(low, start, size)
        rows = self.known.find(one, two)
        new = np.flatnonzero(rows < 0)
        if len(new):
            first, of = grouped(low, start[new], start[new] + size[new])
            rows[new] = self.ids.rows + of
            first = new[first]
            self.known.add(one[first], two[first], self.ids.rows)
            self.ids.add(*self.merger.merge_bytes(low[spread(start[first], size[first])], size[first]))
        return rows

    def others(self, low: np.ndarray, start: np.ndarray, size: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Rows of long parts and odd words, by name."""
        names, odd = [low[a : a + n].tobytes() for a, n in zip(start.tolist(), size.tolist(), strict=True)], (kind == ODD).tolist()
        new = dict.fromkeys((n, o) for n, o in zip(names, odd, strict=True) if n not in self.named)
        if long := [n for n, o in new if not o]:
            self.keep(long, *self.merger.merge(long))
        rest = [n for n, o in new if o]
        for at in range(0, len(rest), 4096):
            some = [e.ids for e in self.library.encode_batch([n.decode() for n in rest[at : at + 4096]], add_special_tokens=False)]
            self.keep(rest[at : at + 4096], np.fromiter(chain.from_iterable(some), np.int32), np.fromiter(map(len, some), np.int64))
        return np.fromiter(map(self.named.__getitem__, names), np.int64, len(names))

    def keep(self, names: list[bytes], ids: np.ndarray, count: np.ndarray) -> None:
        self.named.update(zip(names, range(self.ids.rows, self.ids.rows + len(names)), strict=True))
        self.ids.add(ids, count)


def blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """First row, bytes and places of line ends of each block of a batch's texts; a block ends
    with a text, or at a space in a long one."""
    row = 0
    for some in slices(batch, "text", BLOCK):
        lines = pc.binary_join_element_wise(some.column("text").cast(large := pa.large_string()), pa.scalar("", large), pa.scalar("\n", large))
        _, offsets, data = lines.buffers()
        ends = np.frombuffer(offsets, np.int64)[lines.offset : lines.offset + len(lines) + 1]
        data, ends = data.to_pybytes()[ends[0] : ends[-1]], ends[1:] - ends[0] - 1
        at = before = 0
        while at < len(data):
            past = data.find(b" ", at + BLOCK) + 1
            if past and (later := np.searchsorted(ends, at + BLOCK)) < len(ends):
                past = min(past, int(ends[later]) + 1)
            past = past or len(data)
            inside = int(np.searchsorted(ends, past))
            yield row + before, data[at:past], ends[before:inside] - at
            at, before = past, inside
        row += some.num_rows


def cutter(path: str, capacity: int, remembered: int = REMEMBERED):
    @partial(frugal, trim=False)
    def run(batches):
        pid, seen, words, rows = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), kept_here(WordIds, path, remembered), 0
        for b in batches:
            if not b.num_rows:
                continue
            found, total = [], np.zeros(b.num_rows + 1, np.int64)
            for row, block, ends in blocks(b):
                ids, count = words.of(block, ends)
                found.append(ids)
                total[row : row + len(count)] += count
            total = total[:-1]  # after the last line there is none
            ids = np.concatenate(found).astype("<u4")
            many = -(-total // capacity)
            of = np.repeat(np.arange(b.num_rows), many)
            piece = spread(np.zeros_like(many), many)
            start = piece * capacity
            length = np.minimum(capacity, total[of] - start)
            raw, at = memoryview(ids).cast("B"), 4 * ((np.cumsum(total) - total)[of] + start)
            crc = [zlib.crc32(raw[a:e]) for a, e in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            times = np.bincount(length, minlength=capacity + 1)
            nth = np.empty_like(length)
            nth[order] = spread(seen, times)
            seen += times
            columns = [b.column("doc_id").take(pa.array(of)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(of), pid, np.int32)), pa.array(nth), pa.array((pid << 40) + rows + of)]
            rows += b.num_rows
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in PIECE.split(", ")])

    return run


# -- the plan, on counts -------------------------------------------------------


def dominating(left: np.ndarray, j: int, capacity: int) -> tuple[int, ...] | None:
    """Lengths that together with a piece of length ``j`` dominate all other sets
    that ``j`` could share a sequence with, or None where no small set does.

    ``left``: the number of pieces of each length, without this one of length j.
    """
    room = capacity - j
    fits = np.flatnonzero(left[: room + 1])
    if not len(fits):
        return ()
    big = int(fits[-1])
    if big == room:
        return (big,)
    # The lengths that matter, each as often as three pieces could use it.
    few = np.repeat(fits, np.minimum(left[fits], 3))
    if len(few) < 2 or few[0] + few[1] > room:
        return (big,)
    if len(few) > 2 and few[0] + few[1] + few[2] <= room:
        return None
    # At most two others fit.  The best pair: for each first length the largest second one.
    partner = few[np.maximum(np.searchsorted(few, room - few, side="right") - 1, 0)]
    same = partner == few
    pairs = np.where((few + partner <= room) & (~same | (left[few] > 1)), few + partner, 0)
    if big >= pairs.max():
        return (big,)
    # With the largest piece fixed, a second one b dominates if no two pieces longer than b fit together.
    rest = left.copy()
    rest[big] -= 1
    second = np.flatnonzero(rest[: room - big + 1])
    if len(second):
        b = int(second[-1])
        longer = few[few > b]
        if len(longer) < 2 or longer[0] + longer[1] > room:
            return (big, b)
    return None


def reduce(count: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Fix dominating sets while there are any; ``count`` keeps what is left."""
    fixed = []
    changed = True
    while changed:
        changed = False
        for j in np.flatnonzero(count)[::-1].tolist():
            while count[j]:
                count[j] -= 1
                others = dominating(count, j, capacity)
                count[j] += 1
                if others is None:
                    break
                shape = Counter([j, *others])
                times = min(int(count[w]) // n for w, n in shape.items())
                for w, n in shape.items():
                    count[w] -= n * times
                fixed.append((times, dict(shape)))
                changed = True
    return fixed


def best_fit(count: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Best fit decreasing: groups of equal sequences, by the room left in them."""
    open_: dict[int, list[tuple[int, dict[int, int]]]] = defaultdict(list)
    room_of = np.zeros(capacity + 1, bool)

    def put(times: int, shape: dict[int, int], room: int) -> None:
        open_[room].append((times, shape))
        room_of[room] = True

    for w in np.flatnonzero(count)[::-1].tolist():
        n = int(count[w])
        while n:
            rooms = np.flatnonzero(room_of[w:])
            if not len(rooms):
                per = capacity // w
                if full := n // per:
                    put(full, {w: per}, capacity - per * w)
                if n % per:
                    put(1, {w: n % per}, capacity - (n % per) * w)
                break
            room = int(rooms[0]) + w
            times, shape = open_[room].pop()
            if not open_[room]:
                room_of[room] = False
            # As many of this length in each as it takes: the fullest sequence stays the fullest.
            per = min(room // w, n)
            use = min(times, n // per)
            put(use, shape | {w: per}, room - per * w)
            if times > use:
                put(times - use, shape, room)
            n -= use * per
    return [g for groups in open_.values() for g in groups]


def plan(count: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(number of sequences, pieces of each length in one) for all pieces."""
    count = count.copy()
    return reduce(count, capacity) + best_fit(count, capacity)


def slots(patterns: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """For each pattern and length: length, first number, how many, in one
    sequence, first sequence, offset of the first."""
    out, number, sequence = [], Counter(), 0
    for times, shape in patterns:
        offset = 0
        for w in sorted(shape, reverse=True):
            out.append((w, number[w], times * shape[w], shape[w], sequence, offset))
            number[w] += times * shape[w]
            offset += w * shape[w]
        sequence += times
    return out


def pieces(docs: DataFrame, path: str, capacity: int = 2048, text: str = "text", id: str = "doc_id", remembered: int = REMEMBERED) -> DataFrame:
    """One row for each piece, numbered within its task among those of its length."""
    plain = docs.select(F.col(id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return plain.mapInArrow(cutter(path, capacity, remembered), PIECE)


def pack(docs: DataFrame, path: str, capacity: int = 2048, text: str = "text", id: str = "doc_id", remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece, and
    row_id, a number for each row of ``docs``, which tells pieces of rows with one id apart.
    ``remembered``: parts of words that a Python worker holds; the result does not depend on it."""
    spark = docs.sparkSession
    cut = stash(pieces(docs, path, capacity, text, id, remembered), "pieces")
    # A row for each task and length, so a length of very many pieces is never in one place.
    each = stash(cut.groupBy("length", "pid").agg(F.count("*").alias("n")), "piece-counts")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    count = np.zeros(capacity + 1, np.int64)
    for w, n in each.groupBy("length").agg(F.sum("n")).collect():  # at most ``capacity`` rows
        count[w] = n
    place = slots(plan(count, capacity))
    # At most a few patterns for each of ``capacity`` lengths: small whatever the input.
    table = spark.createDataFrame(pa.table({k: pa.array(c, pa.int64()) for k, c in zip(("length", "first", "many", "per", "sequence", "at"), list(zip(*place, strict=True)) or [[]] * 6, strict=True)}))
    table = table.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "many", "per", "sequence", "at"))).alias("places"))
    numbered = cut.join(each.select("length", "pid", before.alias("before")).hint("merge"), ["length", "pid"]).withColumn("number", F.col("before") + F.col("nth"))
    placed = numbered.join(F.broadcast(table), "length").withColumn("place", F.expr("filter(places, p -> number >= p.first and number < p.first + p.many)[0]"))
    within = F.col("number") - F.col("place.first")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("place.sequence") + F.floor(within / F.col("place.per"))).alias("sequence_id"),
        (F.col("place.at") + within % F.col("place.per") * F.col("length")).alias("offset"),
        "row_id",
    )
