"""Substring deduplication: a compressed FM-index per shard, searched backward by streamed documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm import common
from panelspark.llm.repeats import LAST, Words, repeated_windows
from panelspark.llm.rotations import Rotations, runs_of


class Bits:
    """A bit vector with ranks from 64-bit words and running counts."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    def __init__(self, values: np.ndarray, symbols: int):
        self.n = len(values)
        self.shifts = range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1)
        self.levels, self.zeros = [], []
        for shift in self.shifts:
            bit = (values >> shift) & 1
            self.levels.append(Bits(bit.astype(np.uint8)))
            self.zeros.append(int((bit == 0).sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])
        self.base = self._walk(np.arange(symbols), np.zeros(symbols, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in zip(self.shifts, self.levels, self.zeros):
            ones = bits.ones(at)
            at = np.where((symbol >> shift) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of symbol before each place."""
        return self._walk(symbol, at) - self.base[symbol]


class FMIndex:
    """Burrows-Wheeler transform of a shard's texts in a wavelet matrix, the bounds of equal (T - 1)- and T-prefixes, and the
    smallest document of each T-prefix. Texts and suffix order are not kept."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, first_docs: np.ndarray, window: int):
        self.window, self.symbols = window, int(ids.max(initial=0)) + 1
        rot = Rotations(ids, lengths)
        rank, shorter = rot.ranks(window, window - 1)
        order = np.argsort(rank, kind="stable")
        self.n = len(order)
        self.matrix = WaveletMatrix(rot.symbol[rot.prev[order]].astype(np.int64), self.symbols)
        count = np.bincount(rot.symbol, minlength=self.symbols)
        self.smaller = np.cumsum(count) - count
        opens = np.flatnonzero(np.concatenate([[True], np.diff(shorter[order]) != 0]))
        self.opens = np.append(opens, self.n)
        whole = rot.place + window <= lengths[rot.owner]
        doc = np.where(whole, first_docs[rot.owner], LAST)[order]
        self.block = np.cumsum(np.concatenate([[True], np.diff(rank[order]) != 0])) - 1
        self.low = np.minimum.reduceat(doc, np.flatnonzero(np.concatenate([[True], np.diff(rank[order]) != 0])))

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the rows that continue with symbol on the left."""
        both = self.matrix.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        return self.smaller[symbol] + both[: len(lo)], self.smaller[symbol] + both[len(lo) :]

    def matches(self, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place, smallest document) of every window of the streamed texts that the index holds; symbols it lacks are -1.

        All texts are searched in step. The matching statistic is held at T: a match of T symbols is
        widened to its first T - 1, so the next symbol decides on the next window. Where a symbol fails after L of them, no window over both
        it and those L + 1 places matches, and the search begins anew with its end moved one place to the left.
        """
        live = np.flatnonzero(lengths >= self.window)
        end = lengths[live].copy()
        at, size, lo, hi = end.copy(), np.zeros(len(live), np.int64), np.zeros(len(live), np.int64), np.full(len(live), self.n)
        found = []
        while len(live):
            symbol = ids[starts[live] + at - 1]
            lo2, hi2 = self.extend(np.maximum(symbol, 0), lo, hi)
            ok = (symbol >= 0) & (hi2 > lo2)
            end = np.where(ok, end, end - 1)
            at, size = np.where(ok, at - 1, end), np.where(ok, size + 1, 0)
            lo, hi = np.where(ok, lo2, 0), np.where(ok, hi2, self.n)
            full = np.flatnonzero(size == self.window)
            if len(full):
                found.append((live[full], at[full], self.low[self.block[lo[full]]]))
                part = np.searchsorted(self.opens, lo[full], side="right") - 1
                lo[full], hi[full] = self.opens[part], self.opens[part + 1]
                size[full] -= 1
                end[full] = at[full] + size[full]
            go = (at > 0) & (end >= self.window)
            # A window needs T places left of its end.
            live, end, at, size, lo, hi = (x[go] for x in (live, end, at, size, lo, hi))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found))


def resolve_words(texts: list[bytes], first_docs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index the texts of a shard and stream them past it: runs of windows that start in an earlier document than the text's first."""
    split = [t.split(b" ") for t in texts]
    known: dict[bytes, int] = {}
    lengths = np.array([len(s) for s in split], np.int64)
    ids = np.fromiter((known.setdefault(w, len(known) + 1) for s in split for w in s), np.int64, int(lengths.sum()))
    index = FMIndex(ids, lengths, first_docs, window)
    text, place, low = index.matches(ids, np.cumsum(lengths) - lengths, lengths)
    order = np.lexsort((place, text))
    text, place, low = text[order], place[order], low[order]
    return runs_of(low < first_docs[text], text, place)


def repeated_passages(docs: DataFrame, window: int = 50, gram: int = 8, **options) -> DataFrame:
    """Rows of repeated_windows over words: spans of word positions, kept text with words joined by one space."""
    return repeated_windows(docs, Words, window, gram, resolve_words, **options)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = repeated_passages(common.table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), F.col("n_symbols").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
