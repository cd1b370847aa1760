"""Language-model scores by a weighted backoff automaton.

The model is all n-grams of the training texts, up to order two or three, with Dirichlet
smoothing: p(w | h) = (c(hw) + m p(w | h')) / (c(h) + m), where h' is h without its
first word and p(w) is the add-one base.  As an automaton, every history that was met
is a state; a state has an arc for each word that followed it, weighted with the
smoothed probability, and a failure arc to the next shorter history, weighted with
m / (c(h) + m).  A text is read once from left to right.  In the state that the tokens so
far led to, a token takes its arc, or the failure arcs until a state has one; weights of
all arcs taken are added, and the last leads to the next state.  The texts of a block
are read side by side, one token of each at a time.  A long text is read in pieces; as
a state is known from the last two tokens, a piece begins two tokens early, without
adding weights, which leads to the state that the text before it leads to.

The automaton of a large corpus fits on no machine, and no text needs more of it than
its own n-grams.  Texts are dealt to blocks of bounded size.  Each block sends its
distinct words, and the sorted hashes of its longer n-grams, with what it counted, to
shards by hash range; a shard adds up the blocks and answers each with the totals in
the order asked.  So only distinct n-grams of a block move, and each block builds the
part of the automaton that its texts use.  Counts of words are exact.  N-grams of two and
three words are known by 56-bit hashes; among n of them a share of about n / 2^56 has
the hash of another one and shares its count.  Blocks and shards both grow with the
input, so a message holds fewer n-grams then (some 300 at 30 GB); far beyond that,
``block_bytes`` should grow with what executors can hold.

Defined cases: a null text is the empty text, which is its end alone; null ids have the
remainder of the empty text; repeated rows count and are scored each for itself;
without training texts N and V are 0 and every token has the probability 1.  An empty
table gives an empty result.  Other columns of the input are neither read nor returned.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.shared import id_remainder, partitions, text_of

#: Bytes of text in a block, on average.
BLOCK_BYTES = 6 << 20
#: Bytes of text for each shard that adds up n-grams: its keys of all blocks are held at once.
SHARD_BYTES = 16 << 20
#: Pseudo-counts m of histories of one token, of two tokens, ...: as many as the order has.
STRENGTH = (3000.0, 5.0)
END, START = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC3A5C85C97CB3127)
SENT = "shard int, block int, single binary, single_size int, single_n binary, longer binary, longer_n binary"
ANSWERED = "shard int, block int, single_n binary, longer_n binary, tokens long, types long"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def mixed(a: np.ndarray, b: np.ndarray, order: int) -> np.ndarray:
    """A hash of two hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(order * 0xD6E8FEB86659FD93 & (1 << 64) - 1))
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def squeezed(numbers: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers, compressed with all first bytes first, without last bytes
    that are all 0; before them how many numbers and bytes of each."""
    most = -(-int(numbers.max(initial=0)).bit_length() // 8)
    planes = numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :most].T.tobytes()
    return len(numbers).to_bytes(4, "little") + bytes([most]) + pa.compress(planes, "zstd", asbytes=True)


def stretched(raw: bytes) -> np.ndarray:
    n, most = int.from_bytes(raw[:4], "little"), raw[4]
    out = np.zeros((n, 8), np.uint8)
    if n and most:
        out[:, :most] = np.frombuffer(pa.decompress(raw[5:], n * most, "zstd", asbytes=True), np.uint8).reshape(most, n).T
    return out.view("<u8").reshape(-1)


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return squeezed(np.diff(keys, prepend=np.uint64(0)))


def unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(stretched(raw), dtype=np.uint64)


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class Grams:
    """The tokens of a block's texts and the hashes of their n-grams."""

    def __init__(self, texts: list[str], order: int):
        import xxhash

        ids = _Ids({b"": 0})  # the end, which no word is
        parts = []
        for text in texts:
            words = text.encode().lower().split()
            parts += [np.fromiter(map(ids.__getitem__, words), np.int64, len(words)), np.zeros(1, np.int64)]
        self.tokens, self.words = np.concatenate(parts), list(ids)
        self.size = np.array([len(p) + 1 for p in parts[::2]])
        self.first = np.cumsum(self.size) - self.size
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in ids], np.uint64)
        hashes[0] = END
        self.by_hash = np.argsort(hashes)
        self.hashes = hashes[self.by_hash]
        of = hashes[self.tokens]
        before = np.append(START, of[:-1])
        before[self.first] = START
        pair = mixed(before, of, 2)
        inside = np.ones(len(of), bool)  # where a history of two tokens is
        inside[self.first] = False
        self.inside = np.flatnonzero(inside) if order > 2 else np.empty(0, np.int64)
        # The beginning of a text, all pairs, and the triples of ``inside``.
        grams = [mixed(np.array([START]), START, 1), pair, mixed(pair[self.inside - 1], of[self.inside], 3)]
        self.longer, self.seen, self.which = np.unique(np.concatenate(grams) >> np.uint64(8), return_index=True, return_inverse=True)


def edges(keys: np.ndarray, shards: int, bits: int) -> list[int]:
    """Where each shard's keys begin in sorted keys, and the end."""
    edge = [(i << bits) // shards for i in range(1, shards)]
    return [0, *np.searchsorted(keys, np.array(edge, np.uint64)).tolist(), len(keys)]


def sender(shards: int, order: int):
    """One row for each shard with the block's distinct n-grams and training counts."""

    def run(table: pa.Table) -> pa.Table:
        grams = Grams(table.column("text").to_pylist(), order)
        train = ~table.column("held_out").to_numpy()
        weight = np.repeat(train, grams.size).astype(np.float64)
        single_n = np.bincount(grams.tokens, weights=weight, minlength=len(grams.words)).astype(np.uint64)[grams.by_hash]
        longer_n = np.bincount(grams.which, weights=np.concatenate([[train.sum()], weight, weight[grams.inside]])).astype(np.uint64)
        single, block = [grams.words[i] for i in grams.by_hash.tolist()], table.column("block")[0].as_py()
        at, to = edges(grams.hashes, shards, 64), edges(grams.longer, shards, 56)
        rows = [
            (s, block, pa.compress(b"\n".join(single[at[s] : at[s + 1]]), "zstd", asbytes=True), sum(map(len, single[at[s] : at[s + 1]])) + max(0, at[s + 1] - at[s] - 1), squeezed(single_n[at[s] : at[s + 1]]), packed(grams.longer[to[s] : to[s + 1]]), squeezed(longer_n[to[s] : to[s + 1]]))
            for s in range(shards)
        ]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.int32(), *[pa.binary()] * 3), strict=True)], names=[f.split()[0] for f in SENT.split(", ")])

    return run


def adder(table: pa.Table) -> pa.Table:
    """Totals of a shard, in the order in which each block asked."""

    def totals(which: np.ndarray, counts: str) -> tuple[list[bytes], np.ndarray]:
        each = [stretched(x) for x in table.column(counts).to_pylist()]
        sums = np.bincount(which, weights=np.concatenate(each)).astype(np.uint64)
        return [squeezed(sums[w]) for w in np.split(which, np.cumsum([len(x) for x in each])[:-1])], sums

    words = []
    for raw, size, n in zip(*(table.column(c).to_pylist() for c in ("single", "single_size", "single_n")), strict=True):
        words.append(pa.array(pa.decompress(raw, size, "zstd", asbytes=True).split(b"\n") if n[:4] != bytes(4) else [], pa.binary()))
    single, sums = totals(pa.concat_arrays(words).dictionary_encode().indices.to_numpy(), "single_n")
    asked = np.concatenate([unpacked(x) for x in table.column("longer").to_pylist()])
    longer, _ = totals(np.unique(asked, return_inverse=True)[1], "longer_n")
    n = table.num_rows
    return pa.Table.from_arrays(
        [table.column("shard"), table.column("block"), pa.array(single, pa.binary()), pa.array(longer, pa.binary()), pa.array([int(sums.sum())] * n, pa.int64()), pa.array([int((sums > 0).sum())] * n, pa.int64())],
        names=[f.split()[0] for f in ANSWERED.split(", ")],
    )


class Automaton:
    """States, arcs and failure arcs for the n-grams of a block.

    State 0 is the empty history, 1 + w the history of word w, then come the beginning
    of a text and the histories of two tokens.  The empty history has an arc for every
    word.  Arcs of all other states are sorted by state and word.
    """

    def __init__(self, grams: Grams, single_n: np.ndarray, longer_n: np.ndarray, tokens: int, types: int, strength: tuple[float, ...]):
        self.words, self.start = len(grams.words), 1 + len(grams.words)
        self.floor = (single_n + 1) / (tokens + types + 1)
        self.lowest = np.where((single_n > 0) & (np.arange(self.words) > 0), 1 + np.arange(self.words), 0)
        begun = longer_n[grams.which[0]]
        met, m = np.concatenate([[0.0], single_n, [begun]]), strength[0]
        pair, triple = grams.which[1 : len(grams.tokens) + 1], grams.which[len(grams.tokens) + 1 :]
        before = np.append(self.start, 1 + grams.tokens[:-1])
        before[grams.first] = self.start
        # Each pair that was met, at one of its places.
        kind = np.flatnonzero((longer_n > 0) & (grams.seen > 0) & (grams.seen <= len(grams.tokens)))
        place = grams.seen[kind] - 1
        state, word = before[place], grams.tokens[place]
        chance = np.zeros(len(longer_n))
        chance[kind] = (longer_n[kind] + m * self.floor[word]) / (met[state] + m)
        number = np.zeros(len(longer_n), np.int64)  # of the state that a pair is
        number[kind] = self.start + 1 + np.arange(len(kind)) if len(strength) > 1 else 1 + word
        arcs = [(state, word, chance[kind], np.where(word > 0, number[kind], 0))]
        self.fail, self.fail_weight = np.zeros(self.start + 1, np.int64), np.log10(m / (met + m))
        if len(strength) > 1:
            self.fail = np.concatenate([self.fail, self.lowest[word]])
            self.fail_weight = np.concatenate([self.fail_weight, np.log10(strength[1] / (longer_n[kind] + strength[1]))])
            kind = np.flatnonzero((longer_n > 0) & (grams.seen > len(grams.tokens)))
            place = grams.inside[grams.seen[kind] - 1 - len(grams.tokens)]
            history, last = pair[place - 1], pair[place]
            seen = (longer_n[kind] + strength[1] * chance[last]) / (longer_n[history] + strength[1])
            arcs.append((number[history], grams.tokens[place], seen, np.where(grams.tokens[place] > 0, number[last], 0)))
        state, word, chance, to = (np.concatenate(x) for x in zip(*arcs, strict=True))
        del arcs
        key = state * self.words + word
        order = np.argsort(key)
        self.keys = np.append(key[order], np.iinfo(np.int64).max)
        self.weight, self.to = np.log10(chance[order]), to[order]
        self.log_floor = np.log10(self.floor)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each reader's token weighs, and the state that it leads to."""
        weight, next_ = np.zeros(len(state)), np.empty(len(state), np.int64)
        todo = np.arange(len(state))
        while len(todo):
            at_end = state == 0
            if at_end.any():
                some = todo[at_end]
                weight[some] += self.log_floor[word[at_end]]
                next_[some] = self.lowest[word[at_end]]
                todo, state, word = todo[~at_end], state[~at_end], word[~at_end]
            key = state * self.words + word
            arc = np.searchsorted(self.keys, key)
            has = self.keys[arc] == key
            some, arc = todo[has], arc[has]
            weight[some] += self.weight[arc]
            next_[some] = self.to[arc]
            todo, state, word = todo[~has], state[~has], word[~has]
            weight[todo] += self.fail_weight[state]
            state = self.fail[state]
        return weight, next_

    def read(self, tokens: np.ndarray, first: np.ndarray, size: np.ndarray, piece: int = 128) -> np.ndarray:
        """log10 weight of each token, read from left to right, in pieces of two tokens or more."""
        many = -(-size // piece)
        part = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        lead = np.where(part > 0, 2, 0)
        begin = np.repeat(first, many) + part * piece - lead
        steps = np.minimum(piece, np.repeat(size, many) - part * piece) + lead
        order = np.argsort(-steps, kind="stable")
        begin, lead, steps = begin[order], lead[order], steps[order]
        state = np.where(lead > 0, 0, self.start)
        out = np.zeros(len(tokens))
        left = np.searchsorted(-steps, -np.arange(steps[0]), side="left")  # readers with more than t tokens
        for t, n in enumerate(left.tolist()):
            weight, state = self.step(state[:n], tokens[begin[:n] + t])
            counts = lead[:n] <= t
            out[begin[:n][counts] + t] = weight[counts]
        return out


def scorer(strength: tuple[float, ...]):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        grams = Grams(texts.column("text").to_pylist(), len(strength) + 1)
        answers = answers.sort_by("shard")
        by_hash, longer_n = (np.concatenate([stretched(x) for x in answers.column(c).to_pylist()]).astype(np.float64) for c in ("single_n", "longer_n"))
        tokens, types = sum(answers.column("tokens").to_pylist()), sum(answers.column("types").to_pylist())
        single_n = np.empty(len(grams.words))
        single_n[grams.by_hash] = by_hash
        automaton = Automaton(grams, single_n, longer_n, tokens, types, strength)
        way = automaton.read(grams.tokens, grams.first, grams.size)
        add = lambda x: np.add.reduceat(x, grams.first)
        n = texts.num_rows
        return pa.Table.from_arrays(
            [texts.column("doc_id"), texts.column("held_out"), pa.array(grams.size.astype(np.int64)), pa.array(add((single_n[grams.tokens] > 0).astype(np.int64))), pa.array(np.full(n, tokens, np.int64)), pa.array(add(automaton.log_floor[grams.tokens])), pa.array(add(way))],
            names=[f.split()[0] for f in SCORED.split(", ")],
        )

    return run


def shards_of(size: int, least: int) -> int:
    """How many shards add up the n-grams of ``size`` bytes of text."""
    return max(least, math.ceil(size / SHARD_BYTES))


def score(docs: DataFrame, held_out=None, strength: tuple[float, ...] = STRENGTH, block_bytes: int = BLOCK_BYTES, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row.

    ``held_out``: a condition for rows not to learn from; by default crc32 of the id
    as text, mod 7, is 2.  ``strength``: one or two pseudo-counts, for n-grams to order
    two or three.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id).cast("long").alias("doc_id"), (held_out if held_out is not None else id_remainder(id, 7) == 2).alias("held_out"), text_of(text).alias("text"))
    size = plain.select(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    dealt = plain.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    sent = dealt.groupBy("block").applyInArrow(sender(shards_of(size, 2 * partitions(spark)), len(strength) + 1), SENT)
    answers = sent.groupBy("shard").applyInArrow(adder, ANSWERED)
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scorer(tuple(strength)), SCORED)
