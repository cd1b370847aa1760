"""Rank-synchronous merging of byte-pair encodings on ragged numpy arrays.

All pre-tokens of a batch lie behind one another in one array of symbols.  In each
round every sequence finds the lowest rank among its neighbouring pairs and merges
all its occurrences of that pair, left to right; sequences without a known pair
leave the array.  The number of rounds is that of the longest merge history in the
batch, not of the merges.  A sequence of more than ``LONG`` symbols merges in the same
rounds on its own: its pairs wait by rank, and a round touches only the places of its
rank and their neighbours, so a text without spaces costs no more than its merges.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from heapq import heappop, heappush
from itertools import chain

import numpy as np

NONE = np.int32(2**31 - 1)
#: Symbols of a sequence that merges on its own.
LONG = 512
#: Odd multiplier of Fibonacci hashing.
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def byte_letters() -> list[str]:
    """The visible character that byte-level vocabularies write for each byte."""
    visible = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    letter = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letter[b] for b in range(256)]


def spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers from each ``begin``, as many as its count, behind one another."""
    end = np.cumsum(count)
    return np.repeat(begin - (end - count), count) + np.arange(end[-1] if len(end) else 0)


def every_second(touching: np.ndarray) -> np.ndarray:
    """Which places merge where some touch the one before: of each chain every second one."""
    at = np.arange(len(touching))
    return (at - np.maximum.accumulate(np.where(touching, 0, at))) % 2 == 0


class PairTable:
    """Rank and result of each pair of symbols, in an open-addressed table."""

    def __init__(self, left: np.ndarray, right: np.ndarray, made: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(4 * max(1, len(left))))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        self.made = made.astype(np.int32)
        key, rank = left.astype(np.int64) << 32 | right.astype(np.int64), np.arange(len(left), dtype=np.int32)
        at = self._home(key)
        self.probes = 0
        while len(key):
            self.probes += 1
            free = np.flatnonzero(self.keys[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.ranks[at[put]] = key[put], rank[put]
            rest = np.ones(len(key), bool)
            rest[put] = False
            key, rank, at = key[rest], rank[rest], (at[rest] + 1) & self.mask

    def _home(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * GOLDEN >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = self._home(key)
        found = np.where(self.keys[at] == key, self.ranks[at], NONE)
        open_ = np.flatnonzero((found == NONE) & (self.keys[at] >= 0) & (self.keys[at] != key))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
            here = self.keys[at[open_]]
            same = here == key[open_]
            found[open_[same]] = self.ranks[at[open_[same]]]
            open_ = open_[~same & (here >= 0)]
        return found


class Merger:
    """The merges of one vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.end = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = lambda words: np.fromiter((vocab[w] for w in words), np.int64, len(pairs))
        self.table = PairTable(ids(a for a, _ in pairs), ids(b for _, b in pairs), ids(a + b for a, b in pairs))
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + self.end] for c in letters], np.int32)
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]

    def merge(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words behind one another, and each word's number of ids."""
        return self.merge_bytes(np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words)))

    def merge_bytes(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for words that lie behind one another in ``raw``."""
        sym = self.inner[raw]
        ends = np.cumsum(size)
        if self.end:
            filled = ends[size > 0] - 1
            sym[filled] = self.last[raw[filled]]
        seq = np.repeat(np.arange(len(size), dtype=np.int32), size)
        length = np.zeros(len(size), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        if len(long := np.flatnonzero(size > LONG)):
            for n in long.tolist():
                ids = self._alone(sym[ends[n] - size[n] : ends[n]])
                done.append((np.full(len(ids), n, np.int32), ids))
                length[n] = len(ids)
            short = (size <= LONG)[seq]
            sym, seq = sym[short], seq[short]
        while len(sym):
            start = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            many = np.diff(np.r_[start, len(sym)])
            rank = np.full(len(sym), NONE, np.int32)
            inside = np.flatnonzero(seq[:-1] == seq[1:])
            rank[inside] = self.table.rank(sym[inside], sym[inside + 1])
            least = np.minimum.reduceat(rank, start)
            over = np.repeat(least == NONE, many)
            if over.any():
                done.append((seq[over], sym[over]))
                length[seq[start[least == NONE]]] = many[least == NONE]
            at = np.flatnonzero((rank == np.repeat(least, many)) & ~over)
            if len(at):
                # Of touching occurrences (equal symbols in a row) every second one merges.
                at = at[every_second(np.r_[False, np.diff(at) == 1])]
                sym[at] = self.table.made[rank[at]]
            keep = ~over
            keep[at + 1] = False
            sym, seq = sym[keep], seq[keep]
        if not done:
            return np.empty(0, np.int32), length
        where, ids = np.concatenate([w for w, _ in done]), np.concatenate([s for _, s in done])
        return ids[np.argsort(where, kind="stable")], length

    def _alone(self, sym: np.ndarray) -> np.ndarray:
        """The ids that one long sequence leaves."""
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        now = np.append(self.table.rank(sym[:-1], sym[1:]), NONE)  # rank of the pair that begins here
        alive = np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def wait(places: np.ndarray) -> None:
            places = places[now[places] != NONE]
            places = places[np.argsort(now[places], kind="stable")]
            for part in np.split(places, np.flatnonzero(np.diff(now[places])) + 1) if len(places) else ():
                rank = int(now[part[0]])
                if rank not in waiting:
                    heappush(ranks, rank)
                waiting.setdefault(rank, []).append(part)

        wait(np.arange(n))
        while ranks:
            rank = heappop(ranks)
            at = np.unique(np.concatenate(waiting.pop(rank)))
            at = at[now[at] == rank]
            if not len(at):
                continue
            at = at[every_second(np.r_[False, after[at[:-1]] == at[1:]])]
            gone = after[at]
            sym[at], now[gone], alive[gone] = self.table.made[rank], NONE, False
            after[at] = after[gone]
            followed = at[after[at] < n]
            before[after[followed]] = followed
            touched = np.unique(np.concatenate([at, before[at][before[at] >= 0]]))
            right = after[touched]
            now[touched] = np.where(right < n, self.table.rank(sym[touched], sym[np.minimum(right, n - 1)]), NONE)
            wait(touched)
        return sym[alive]


class Ragged:
    """A growing table of rows of ids."""

    def __init__(self):
        self.ids, self.begin, self.count = np.empty(1 << 16, np.int32), np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64)
        self.n_ids = self.rows = 0

    def add(self, ids: np.ndarray, count: np.ndarray) -> None:
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while self.rows + len(count) > len(self.begin):
            self.begin, self.count = (np.concatenate([x, np.empty_like(x)]) for x in (self.begin, self.count))
        end = self.rows + len(count)
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.count[self.rows : end] = count
        self.begin[self.rows : end] = self.n_ids + np.cumsum(count) - count
        self.n_ids, self.rows = self.n_ids + len(ids), end

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these rows behind one another, and each row's number of ids."""
        count = self.count[rows]
        return self.ids[spread(self.begin[rows], count)], count


def spans(text: str, size: int = 1 << 20) -> Iterator[str]:
    """Pieces of a long text, cut only before a single space between two words.

    No pre-token of the patterns used here goes over such a place.
    """
    at = 0
    while len(text) - at > size:
        cut = at + size
        while (cut := text.find(" ", cut)) >= 0 and (text[cut - 1].isspace() or text[cut + 1 : cut + 2].isspace() or cut + 1 == len(text)):
            cut += 1
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def unknown(lists: Iterable[list[str]], memo: dict) -> list[str]:
    return list({w for w in chain.from_iterable(lists) if w not in memo})
