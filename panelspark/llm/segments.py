"""Content-defined segments of symbol streams: every window of T symbols lies in one segment, named by its smallest gram."""

from __future__ import annotations

import numpy as np

from panelspark.llm.words import mix

R = 0x9E3779B97F4A7C15 | 1
R_INVERSE = pow(R, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Prefix:
    """Prefix sums of symbol * R^position: the hash of any run of symbols, whatever its place, in two look-ups."""

    def __init__(self, symbols: np.ndarray):
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.add.accumulate(symbols * powers(R, len(symbols)), out=self.sums[1:])
        self.back = powers(R_INVERSE, len(symbols) + 1)

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))

    def grams(self, n: int) -> np.ndarray:
        return mix((self.sums[n:] - self.sums[:-n]) * self.back[: len(self.sums) - n] + np.uint64(n))


def slide_min(values: np.ndarray, width: int) -> np.ndarray:
    out, n = values, 1
    while 2 * n <= width:
        out = np.minimum(out[:-n], out[n:])
        n *= 2
    return np.minimum(out[: len(out) - (width - n)], out[width - n :]) if width > n else out


def segments(symbols: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, start, windows, content hash) of the segments of documents bounds[i]:bounds[i + 1].

    A segment is a longest run of consecutive windows of one document with the same smallest gram hash, which names its key;
    it covers windows + window - 1 symbols. Equal windows have equal keys wherever they stand.
    """
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(symbols) - window + 1
    if n <= 0:
        return none
    prefix = Prefix(symbols)
    low = slide_min(prefix.grams(gram), window - gram + 1)
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(of[:n] == of[window - 1 :])
    if not len(at):
        return none
    low, of = low[at], of[at]
    opens = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (of[1:] != of[:-1])]))
    count = np.diff(np.append(opens, len(at)))
    start = at[opens]
    # Minima crowd at low values; scrambled they spread evenly over shards and bit tables.
    return mix(low[opens]), start, count, prefix.runs(start, start + count + window - 1)
