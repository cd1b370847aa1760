"""Numbers that Spark has no expression for: small functions on numpy arrays."""

from __future__ import annotations

import math

import numpy as np

UNIT = float(np.finfo(float).eps)
TINY = float(np.finfo(float).tiny)


def erfc(x: np.ndarray) -> np.ndarray:
    return np.array([math.erfc(v) if v == v else math.nan for v in np.asarray(x, float).ravel()])


def chi_square_survival(statistic: float, degrees: int) -> float:
    """P(X >= statistic) for a chi-square of whole positive degrees.

    For whole degrees the tail is a finite sum: Q(1/2, z) = erfc(sqrt z) or Q(1, z) =
    exp(-z), and Q(a + 1, z) = Q(a, z) + z^a exp(-z) / Gamma(a + 1).
    """
    if degrees <= 0 or not math.isfinite(statistic) or statistic < 0:
        raise ValueError("chi-square needs positive degrees and a finite statistic of at least 0")
    z = statistic / 2
    if z == 0:
        return 1.0
    a, tail = (0.5, math.erfc(math.sqrt(z))) if degrees % 2 else (1.0, math.exp(-z))
    while a < degrees / 2:
        tail += math.exp(a * math.log(z) - z - math.lgamma(a + 1))
        a += 1
    return min(1.0, tail)


def varies(x: np.ndarray) -> bool:
    """Whether the variation about the mean can be told from rounding."""
    if not len(x):
        return False
    c = x - x.mean()
    return float(c @ c) > UNIT * max(float(x @ x), TINY)


def lag_limit(n: int, most: int) -> int:
    return 0 if n < 4 else min(most, n // 4, n - 2)


def factor(c: np.ndarray, lags: int, start: int, rows: int = 8192) -> np.ndarray:
    """Triangular factor of the rows (1, c[t-1], ..., c[t-lags], c[t]) from t = start on."""
    found = np.empty((0, lags + 2))
    for t in range(max(start, lags), len(c), rows):
        window = np.lib.stride_tricks.sliding_window_view(c[t - lags : t + rows], lags + 1)
        found = merged([found, np.c_[np.ones(len(window)), window[:, -2::-1], window[:, -1]]])
    return found


def merged(factors: list[np.ndarray]) -> np.ndarray:
    """Factor of all rows that the factors stand for; its singular values are theirs."""
    return np.linalg.qr(np.vstack(factors), mode="r")


def last_coefficients(whole: np.ndarray, head: np.ndarray, n: int) -> list[float | None]:
    """Last coefficient of the regression on 1, 2, ... lags with an intercept; null where
    the rows have not full rank.

    ``whole``: the factor for the most lags; ``head``: the first values, of which the
    regressions on fewer lags have more rows.
    """
    lags, out = len(head), []
    for lag in range(1, lags + 1):
        more = np.array([[1.0, *head[t - lag : t][::-1], head[t]] for t in range(lag, lags)]).reshape(-1, lag + 2)
        rows = np.vstack([whole[:, [*range(lag + 1), lags + 1]], more])
        beta, _, rank, _ = np.linalg.lstsq(rows[:, :-1], rows[:, -1], rcond=UNIT * max(n - lag, lag + 1))
        out.append(float(beta[-1]) if rank == lag + 1 else None)
    return out


def partial_autocorrelations(x: np.ndarray, most: int) -> list[float | None]:
    """Last coefficient of the regression on 1, 2, ... lags with an intercept."""
    k, c = lag_limit(len(x), most), x - x.mean() if len(x) else x
    return last_coefficients(factor(c, k, 0), c[:k], len(x)) if k and varies(x) else [None] * k


def block_means(x: np.ndarray, block: int, resamples: int, seed: int) -> np.ndarray:
    """Means of circular moving-block resamples, from running sums.

    Starts are drawn resample by resample, so a seed gives the same starts for every
    series of one length; a resample costs its blocks, not its observations.
    """
    n = len(x)
    blocks = -(-n // block)
    last = n - (blocks - 1) * block
    total = np.concatenate([[0.0], np.cumsum(np.concatenate([x, x[:block]]))])
    generator = np.random.default_rng(seed)
    starts = np.stack([generator.integers(0, n, size=blocks) for _ in range(resamples)])
    sums = total[starts[:, :-1] + block] - total[starts[:, :-1]]
    return (sums.sum(axis=1) + total[starts[:, -1] + last] - total[starts[:, -1]]) / n


#: Raw numbers of a generator that are turned into draws at a time.
CHUNK = 1 << 16


def raw_numbers(seed: int, n: int, first: int):
    """Raw numbers of a generator of the seed from number ``first`` on, some at a time,
    as it takes them for draws below n: up to 2^32 a raw number of 64 bits is two of 32
    bits, the lower half first."""
    bit_generator = np.random.PCG64(seed)
    narrow = n <= 1 << 32
    bit_generator.advance(first // 2 if narrow else first)
    skipped = first % 2 if narrow else 0
    while True:
        raw = bit_generator.random_raw(-(-CHUNK // 2) if narrow else CHUNK).astype("<u8", copy=False)
        yield (raw.view("<u4") if narrow else raw)[skipped:]
        skipped = 0


def gives(raw: np.ndarray, n: int) -> np.ndarray:
    """Which raw numbers give a draw below n: a number u gives the high half of u * n,
    and none where the low half is below 2^bits mod n.  So whether it gives a draw does
    not depend on those before it, and any slice of the stream can be drawn on its own."""
    refused = (1 << 8 * raw.itemsize) % n
    return raw * raw.dtype.type(n) >= raw.dtype.type(refused) if refused else np.ones(len(raw), bool)


def highs(raw: np.ndarray, n: int) -> np.ndarray:
    """High half of u * n for each raw number u."""
    half = np.uint64(32)
    if raw.itemsize == 4:
        found = raw.astype(np.uint64)
        found *= np.uint64(n)
        found >>= half
        return found.view(np.int64)
    a, b, c, d = raw >> half, raw & np.uint64(0xFFFFFFFF), np.uint64(n >> 32), np.uint64(n & 0xFFFFFFFF)
    middle = a * d + ((b * d) >> half)
    cross = (middle & np.uint64(0xFFFFFFFF)) + b * c
    return (a * c + (middle >> half) + (cross >> half)).astype(np.int64)


def counted_draws(seed: int, n: int, first: int, count: int) -> int:
    """How many draws below n the raw numbers ``first`` to ``first + count`` give."""
    found, left = 0, count
    for raw in raw_numbers(seed, n, first):
        found += int(np.count_nonzero(gives(raw[:left], n)))
        left -= len(raw)
        if left <= 0:
            return found


def raw_draws(seed: int, n: int, first: int, count: int):
    """Draws below n that a generator of the seed makes of its raw numbers ``first`` to
    ``first + count``, in order, some at a time."""
    left = count
    for raw in raw_numbers(seed, n, first):
        yield highs(raw[:left][gives(raw[:left], n)], n)
        left -= len(raw)
        if left <= 0:
            return


def stream(seed: int, n: int, first: int, skip: int, count: int):
    """Raw numbers that hold ``count`` draws below n, after ``skip`` draws from raw number
    ``first`` on, some at a time; and which of them give a draw."""
    left = count
    for raw in raw_numbers(seed, n, first):
        if left <= 0:
            return
        ok = gives(raw, n)
        found = int(np.count_nonzero(ok))
        if skip >= found:
            skip -= found
            continue
        if skip or found > left:
            at = np.flatnonzero(ok)[skip : skip + left]
            raw, ok, skip, found = raw[at[0] : at[-1] + 1], ok[at[0] : at[-1] + 1], 0, len(at)
        left -= found
        yield raw, ok


def drawn(seed: int, n: int, start: int, count: int, counts: np.ndarray, slice_size: int):
    """Draws ``start`` to ``start + count`` below n, some at a time.  ``counts``: draws in
    each slice of ``slice_size`` raw numbers, as far as known."""
    before = np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64))])
    slice_ = int(np.searchsorted(before, start, "right")) - 1
    for raw, ok in stream(seed, n, slice_ * slice_size, start - int(before[slice_]), count):
        yield highs(raw[ok], n)


def block_sums(level: np.ndarray, low: int, total: float, n: int, block: int, resamples: int, seed: int, first: int, skip: int) -> np.ndarray:
    """What some running sums of a series of n know of the sums of circular moving-block
    resamples: over all its parts these add up to the sums.

    ``level``: the running sums before the places from ``low`` on, then one 0 for all other places;
    ``total``: the sum of the series.  The resamples' draws are those of the seed's
    stream after ``skip`` draws from raw number ``first`` on.  A block of which neither
    end is among the places is told by its raw number alone, and costs no more.
    """
    size, blocks = len(level) - 1, -(-n // block)
    last, known, at = n - (blocks - 1) * block, np.zeros(resamples), 0
    everywhere = size + block >= n
    for raw, ok in stream(seed, n, first, skip, resamples * blocks):
        if at == 0:
            space, kind = 1 << 8 * raw.itemsize, raw.dtype.type
            # Blocks that begin at places from low - block to the last have raw numbers between these.
            begin, end = (-(-place * space // n) for place in ((low - block) % n, low + size))
            begin, width = kind(begin), kind((end - begin) % space)
        found = int(np.count_nonzero(ok))
        near = np.flatnonzero((raw - begin < width) & ok) if not everywhere else np.flatnonzero(ok) if found < len(ok) else slice(None)
        one = at // blocks == (at + found) // blocks
        if one:
            length = block
        else:
            place = at + (np.cumsum(ok) - 1)[near]
            of = place // blocks
            length = np.where(place - of * blocks == blocks - 1, last, block)
        start = highs(raw[near], n)
        stop = start + length
        around = np.flatnonzero(stop >= n)
        stop[around] -= n
        if size < n:
            # Places before low turn into large numbers, so what lies elsewhere gets the 0.
            start, stop = (np.minimum((x - low).view(np.uint64), np.uint64(size)).view(np.int64) for x in (start, stop))
        sums = level.take(stop)
        sums -= level.take(start)
        sums[around] += total * (start[around] < size)
        if one:
            known[at // blocks] += sums.sum()
        elif len(sums):
            known[of[0] : of[-1] + 1] += np.bincount(of - of[0], sums)
        at += found
    return known
