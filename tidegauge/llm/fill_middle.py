"""Fill-in-the-middle: whole texts cut at two token boundaries and reordered.

The token starts of a batch of texts form one bit for each byte, packed into 64-bit
words with a directory of the ones before each block of eight words.  The ones of a text
are its tokens; its two cuts are ranks, and ``select`` on them gives byte positions.
Only the cuts come back from Python: the JVM cuts the bytes and puts the parts together.

Defined cases: a null text is the empty text, which stays plain; so do texts that
contain a marker, as they could not be told from a transformed one.  A null id counts as
the empty text in the hash.  Repeated rows and ids give the same result each.  A text of
any length is marked in parts of ``PART`` bytes and never copied as a whole in Python.
An empty table gives an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.shared import text_of

#: Markers before prefix, suffix and middle, and percentages (fixed values of the contract).
MARKS = ("<P>", "<S>", "<M>")
TRANSFORMED, SUFFIX_FIRST = 90, 20
#: Bytes that are marked at a time; words of a directory's block.
PART, BLOCK = 1 << 20, 8


class Bits:
    """A packed bitvector with rank and select."""

    def __init__(self, words: np.ndarray):
        self.words = np.pad(words, (0, -len(words) % BLOCK))
        held = np.bitwise_count(self.words).reshape(-1, BLOCK)
        #: Ones before each block, and all of them at the end.
        self.before = np.concatenate([[0], np.cumsum(held.sum(axis=1, dtype=np.int64))])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        block, word, bit = at // (64 * BLOCK), at // 64, at % 64
        out = self.before[block]
        for k in range(BLOCK):
            whole = block * BLOCK + k < word
            out = out + np.where(whole, np.bitwise_count(self._word(block * BLOCK + k)), 0)
        return out + np.bitwise_count(self._word(word) & ((np.uint64(1) << bit.astype(np.uint64)) - np.uint64(1)))

    def select(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th one, counted from 0."""
        block = np.searchsorted(self.before, k, "right") - 1
        left, word = k - self.before[block], block * BLOCK
        for _ in range(BLOCK - 1):
            held = np.bitwise_count(self._word(word)).astype(np.int64)
            onward = (left >= held) & (word < (block + 1) * BLOCK - 1)
            stays = ~onward
            left, word = left - np.where(onward, held, 0), word + onward
            if stays.all():
                break
        bits = np.unpackbits(self._word(word).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return word * 64 + np.argmax(np.cumsum(bits, axis=1) > left[:, None], axis=1)

    def _word(self, at: np.ndarray) -> np.ndarray:
        return self.words[np.minimum(at, len(self.words) - 1)] if len(self.words) else np.zeros(len(at), np.uint64)


def token_starts(data: np.ndarray, starts: np.ndarray) -> Bits:
    """A bit for each byte of UTF-8 that starts a run of ASCII letters or any other code
    point; ``starts``: where texts begin, as runs do not cross them."""
    words, part = np.zeros(-(-len(data) // 64) + 1, np.uint64), np.zeros(PART + 1, np.bool_)
    starts = np.unique(starts[starts < len(data)])
    into = words.view(np.uint8)
    for at in range(0, len(data), PART):
        piece = data[at : at + PART]
        letter = part[1 : len(piece) + 1]
        np.less((piece | 32) - np.uint8(97), 26, out=letter)
        first = (piece & 0xC0) != 0x80
        first &= ~(letter & part[: len(piece)])
        first[starts[np.searchsorted(starts, at) : np.searchsorted(starts, at + len(piece))] - at] = True
        packed = np.packbits(first, bitorder="little")
        into[at // 8 : at // 8 + len(packed)] = packed
        part[0] = letter[-1]
    return Bits(words)


def cut_texts(text: pa.Array, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text and the byte positions of its two cuts."""
    raw = text.cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    low = int(ends[0]) if len(ends) else 0
    data = np.frombuffer(raw.buffers()[2], np.uint8)[low : int(ends[-1])] if len(raw) and raw.buffers()[2] else np.empty(0, np.uint8)
    start, end = ends[:-1] - low, ends[1:] - low
    bits = token_starts(data, start)
    first = bits.rank(start)
    n = bits.rank(end) - first
    at = np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)]), axis=0)
    cuts = [np.where(k < n, bits.select(np.minimum(first + k, max(bits.before[-1] - 1, 0))), end) - start for k in at]
    return n, *cuts


CUTS = T.StructType([T.StructField(c, T.LongType()) for c in ("n", "left", "right")])


@F.arrow_udf(CUTS)
def cuts_of(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    n, left, right = cut_texts(text, h1.to_numpy(zero_copy_only=False), h2.to_numpy(zero_copy_only=False))
    return pa.StructArray.from_arrays([pa.array(n), pa.array(left), pa.array(right)], names=["n", "left", "right"])


def transform(docs: DataFrame, seed: str = "1:", text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (null if
    plain) and output of each row.  Draws come from the hash of ``seed`` and the id."""
    key = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col(id).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(key, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    raw = docs.select(F.col(id).cast("long").alias("doc_id"), text_of(text).alias("text"), *draws)
    marked = F.lit(False)
    for mark in MARKS:
        marked |= F.contains("text", F.lit(mark))
    stays = (F.col("text") == "") | marked | (F.col("h3") % 100 >= TRANSFORMED)
    form = F.when(stays, "plain").when(F.col("h4") % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    found = raw.withColumn("cut", cuts_of("text", "h1", "h2")).select("doc_id", "text", form.alias("form"), "cut.*")
    left, right = F.col("left").cast("int"), F.col("right").cast("int")
    part = lambda start, size: F.substring(F.col("text").cast("binary"), start, size).cast("string")
    parts = found.select("doc_id", "n", "form", "text", part(F.lit(1), left).alias("prefix"), part(left + 1, right - left).alias("middle"), part(right + 1, F.octet_length("text") - right).alias("suffix"))
    p, s, m = map(F.lit, MARKS)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).otherwise(F.concat(s, "suffix", p, "prefix", m, "middle"))
    chars = lambda c: F.when(F.col("form") != "plain", F.char_length(c).cast("long")).alias(f"{c}_chars")
    return parts.select("doc_id", "n", "form", chars("prefix"), chars("middle"), output.alias("output"))


def restore(found: DataFrame) -> DataFrame:
    """Adds ``restored``, the text rebuilt from output and form alone.

    A transformed text holds no marker of its own, so each stands once in the output.
    """
    parts = F.split(F.expr(f"substring(output, {len(MARKS[0]) + 1})"), "|".join(MARKS))
    cut = found.withColumn("_parts", F.when(F.col("form") != "plain", parts))
    order = {"psm": (0, 2, 1), "spm": (1, 2, 0)}
    text = F.col("output")
    for form, places in order.items():
        text = F.when(F.col("form") == form, F.concat(*[F.get("_parts", F.lit(i)) for i in places])).otherwise(text)
    return cut.withColumn("restored", text).drop("_parts")
