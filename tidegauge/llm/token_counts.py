"""Token counts of whole texts by rank-synchronous merging (see ``bpe``).

Texts are split at the vocabulary's special strings and into pre-tokens; the
pre-tokens that a task has not met yet are merged together in one ragged array,
and each text adds up what its pre-tokens leave.

Defined cases: a null text is the empty text and has no tokens; special strings
inside a text are one token each, as the library has it by default; repeated rows
and ids are counted each for itself; an empty table gives an empty result.  Other
columns of the input are neither read nor returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.bpe import Merger, spans, unknown
from tidegauge.llm.shared import text_of

#: How byte-level vocabularies cut a text into pre-tokens (a fixed value).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that are pre-tokenised at a time, and pre-tokens remembered by a task.
BLOCK, REMEMBERED = 1 << 21, 1 << 20


def counter(path: str):
    def run(batches):
        import regex

        merger, find = Merger(path), regex.compile(PRE_TOKEN).findall
        special = regex.compile("|".join(map(regex.escape, merger.special)) or r"(?!)")
        memo: dict[str, int] = {}

        def flush(parts: list[tuple[int, list[str]]], total: np.ndarray) -> None:
            if len(memo) > REMEMBERED:
                memo.clear()
            if new := unknown((p for _, p in parts), memo):
                memo.update(zip(new, merger.merge([w.encode() for w in new])[1].tolist(), strict=True))
            for row, part in parts:
                total[row] += sum(map(memo.__getitem__, part))

        for b in batches:
            total, size = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            parts, held = [], 0
            for row, value in enumerate(b.column("text")):
                text = value.as_py()
                size[row] = len(text) if text.isascii() else len(text.encode())
                pieces = special.split(text)
                total[row] = len(pieces) - 1
                for piece in pieces:
                    for span in spans(piece):
                        parts.append((row, find(span)))
                        held += len(span)
                        if held >= BLOCK:
                            flush(parts, total)
                            parts, held = [], 0
            flush(parts, total)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size), pa.array(total)], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row.  ``path``: a byte-level
    vocabulary file, readable on the executors."""
    plain = docs.select(F.col(id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    counted = plain.mapInArrow(counter(path), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
