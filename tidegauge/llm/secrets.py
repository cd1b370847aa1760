r"""Secret scans: known shapes, and sliding-window entropy over candidate strings.

Everything is a DataFrame expression.  Matches come from ``regexp_extract_all`` and
what stands between them from ``split`` with the same pattern; their lengths add up
to positions (code points, end exclusive).

Candidates are longest runs of base-64 letters.  A window of ``WINDOW`` characters
slides over each; counts of its characters are updated by the one that enters and the
one that leaves, and with them the sum of c*log2(c), from which the window's Shannon
entropy follows.  Runs of only hexadecimal digits have a threshold of their own, as
their alphabet is smaller.  A span reaches from the first to the end of the last window
that meets the threshold.  Sums are whole millionths, so results do not depend on the
order of additions.  Runs on the allow list (placeholders, identifiers, plain numbers
and words) and spans that touch a known shape are suppressed; known shapes stay.

Defined cases: a null text is the empty text and has no spans; repeated rows are
scanned each for itself; a text with very many matches costs little more than their number
(places come from blocks, overlaps from halving); an empty table gives an empty result.  Other columns of the
input are neither read nor returned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.shared import text_of

# Fixed values of the contract.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
LEAST_ASSIGNED, LEAST_ACCESS = 6, 20

KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ONLY_HEX = r"^[0-9a-fA-F]+$"
#: Bits per character that a window needs.
LEAST_BITS = {"hex": 3.0, "base64": 3.8}
#: Runs that are not secrets: placeholders, UUIDs, plain numbers, and letters of one kind only.
ALLOWED = (
    r"(?i:example|sample|placeholder|dummy|changeme|lorem|xxxx|0123456789|abcdefgh)",
    r"^(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})$",
    r"^[0-9+/_=-]+$",
    r"^[^0-9]+$",
)
MILLION = 1_000_000
#: Matches that are placed together.
PART = 256
#: c*log2(c) in millionths for each count that a window can hold.
C_LOG_C = [0, 0, *(round(MILLION * c * math.log2(c)) for c in range(2, WINDOW + 1))]


def most_c_log_c(bits: float) -> int:
    """The largest sum of c*log2(c) at which a window has so many bits per character."""
    return math.floor(MILLION * WINDOW * (math.log2(WINDOW) - bits))


def found(text: str, pattern: str) -> tuple[Column, Column]:
    """Matches of a pattern and what stands before each."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def running(array: str, first: str, step: str, out: str) -> str:
    """What ``out`` gives of (acc, x) for each element x of an array, with acc at ``first`` and going
    on by ``step``; an array grows by copying, so elements come in blocks of ``PART``."""
    return f"aggregate({array}, named_struct('at', {first}, 'out', array()), (acc, x) -> named_struct('at', {step}, 'out', concat(acc.out, array({out}))), acc -> acc.out)"


def placed(matches: str, gaps: str, kind: int) -> Column:
    """An array of (start, kind, end, match), from sums over blocks of matches and sums within a block."""
    kinds, step = "cast(array() as array<struct<start: int, kind: int, end: int, match: string>>)", "acc.at + length(x.gap) + length(x.match)"
    parts = f"""transform(filter(sequence(0, size({matches}) - 1, {PART}), i -> i < size({matches})), i ->
        zip_with(slice({gaps}, i + 1, {PART}), slice({matches}, i + 1, {PART}), (g, m) -> if(m is null, null, named_struct('gap', g, 'match', m))))"""
    inside = running("filter(p.part, y -> y is not null)", "p.from", step, f"named_struct('start', acc.at + length(x.gap), 'kind', {kind}, 'end', {step}, 'match', x.match)").replace("array())", kinds + ")", 1)
    sums = "transform(parts, p -> aggregate(filter(p, y -> y is not null), 0, (n, x) -> n + length(x.gap) + length(x.match)))"
    starts = running(sums, "0", "acc.at + x", "acc.at").replace("array())", "cast(array() as array<int>))", 1)
    joined = f"flatten(transform(zip_with(parts, {starts}, (part, from) -> named_struct('part', part, 'from', from)), p -> {inside}))"
    return F.expr(f"if(size({matches}) = 0, {kinds}, transform(array({parts}), parts -> {joined})[0])")


def touched(span: str, spans: str) -> str:
    """Whether a span overlaps one of ``spans``, which rise and do not overlap each other: the
    first that ends behind its start is found by halving."""
    middle = "(acc.lo + acc.hi) div 2"
    at = f"""aggregate(sequence(1, 32), named_struct('lo', 0, 'hi', size({spans})),
        (acc, _) -> if(acc.lo >= acc.hi, acc, if({spans}[cast({middle} as int)].end > {span}.start, named_struct('lo', acc.lo, 'hi', cast({middle} as int)), named_struct('lo', cast({middle} as int) + 1, 'hi', acc.hi))), acc -> acc.lo)"""
    return f"(size({spans}) > 0 and coalesce(transform(array({at}), k -> k < size({spans}) and get({spans}, k).start < {span}.end)[0], false))"


def windows(run: str, most: str) -> str:
    """First start and last end (from 0, within ``run``) of the windows whose sum of
    c*log2(c) is at most ``most``; first is null if there is none.

    Of the counts of a window's characters only two change: that of the character that
    leaves and that of the one that enters, so only these are taken from the window.
    """
    table = f"array({', '.join(map(str, C_LOG_C))})"
    count = lambda held, letter: f"(length({held}) - length(replace({held}, {letter}, '')))"
    leaving = f"if(length(acc.held) = {WINDOW}, {table}[{count('acc.held', 'left(acc.held, 1)')}] - {table}[{count('acc.held', 'left(acc.held, 1)')} - 1], 0)"
    entering = f"{table}[{count('rest', 'letter')} + 1] - {table}[{count('rest', 'letter')}]"
    good = f"length(next.held) = {WINDOW} and next.sum <= {most}"
    return f"""aggregate(split({run}, ''), named_struct('end', 0, 'held', '', 'sum', 0, 'first', cast(null as int), 'last', 0),
        (acc, letter) -> transform(transform(array(if(length(acc.held) = {WINDOW}, substring(acc.held, 2), acc.held)), rest ->
                named_struct('end', acc.end + 1, 'held', concat(rest, letter), 'sum', acc.sum - ({leaving}) + ({entering}))), next ->
            named_struct('end', next.end, 'held', next.held, 'sum', next.sum, 'first', if(acc.first is null and {good}, next.end - {WINDOW}, acc.first), 'last', if({good}, next.end, acc.last)))[0],
        acc -> named_struct('first', acc.first, 'last', acc.last))"""


def joined(spans: str) -> Column:
    names = f"array({', '.join(repr(k) for k in KINDS)})"
    return F.expr(f"array_join(transform({spans}, s -> concat({names}[s.kind], ':', s.start, ':', s.end)), ',')")


def scan(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each row."""
    df = docs.select(F.col(id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "entropy": CANDIDATE}
    raw = {k: found("text", p) for k, p in patterns.items()}
    df = df.select("doc_id", *[c.alias(f"{k}_{part}") for k, pair in raw.items() for part, c in zip(("matches", "gaps"), pair, strict=True)])
    df = df.select("doc_id", *[placed(f"{k}_matches", f"{k}_gaps", n).alias(k) for n, k in enumerate(KINDS)])
    df = df.withColumns(
        {
            "assign": F.filter("assign", lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 1)) >= LEAST_ASSIGNED),
            "access": F.filter("access", lambda s: F.length(s["match"]) >= LEAST_ACCESS),
            "entropy": F.filter("entropy", lambda s: ~_any(s["match"])),
        }
    )
    most = f"if(s.match rlike '{ONLY_HEX}', {most_c_log_c(LEAST_BITS['hex'])}, {most_c_log_c(LEAST_BITS['base64'])})"
    strong = F.expr(f"transform(entropy, s -> named_struct('start', s.start, 'kind', s.kind, 'w', {windows('s.match', most)}))")
    df = df.withColumn("strong", strong).withColumn("base", F.expr("transform(concat(assign, access, hex), s -> named_struct('start', s.start, 'kind', s.kind, 'end', s.end))"))
    df = df.withColumn("added", F.expr("""filter(transform(filter(strong, s -> s.w.first is not null), s -> named_struct('start', s.start + s.w.first, 'kind', s.kind, 'end', s.start + s.w.last)),
        s -> not (%s))""" % " or ".join(touched("s", k) for k in KINDS[:3])))
    df = df.withColumns({"base": F.sort_array("base"), "every": F.sort_array(F.concat("base", "added"))})
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return df.select("doc_id", *counts, F.sha2(F.encode(joined("base"), "UTF-8"), 256).alias("base_sha256"), joined("every").alias("spans"))


def _any(run: Column) -> Column:
    out = F.lit(False)
    for pattern in ALLOWED:
        out = out | run.rlike(pattern)
    return out
