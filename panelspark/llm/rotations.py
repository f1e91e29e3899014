"""Cyclic strings laid out in one array, and their rotations sorted to a depth."""

from __future__ import annotations

import numpy as np


class Rotations:
    """Strings of symbols > 0, each followed by the terminator 0; next and prev are cyclic within a string."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        """symbols: all strings end to end, without terminators."""
        self.first = np.cumsum(lengths + 1) - (lengths + 1)
        self.size = lengths + 1
        n = int(self.size.sum())
        self.owner = np.repeat(np.arange(len(lengths)), self.size)
        self.place = np.arange(n) - self.first[self.owner]
        self.symbol = np.zeros(n, symbols.dtype)
        self.symbol[self.place < lengths[self.owner]] = symbols
        self.prev = np.arange(n) - 1
        self.prev[self.first] = self.first + lengths

    def ahead(self, steps: int) -> np.ndarray:
        return self.first[self.owner] + (self.place + steps) % self.size[self.owner]

    def ranks(self, depth: int, also: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each rotation by its first `depth` symbols, equal for equal prefixes, and by its first `also`, by doubling."""
        rank, width = self.symbol.astype(np.int64), 1
        other = rank
        while width < depth:
            step = min(width, depth - width)
            if also is not None and width < also <= width + step:
                other = _pairs(rank, rank[self.ahead(also - width)])
            rank, width = _pairs(rank, rank[self.ahead(step)]), width + step
        return rank, other


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    key = a * (int(b.max(initial=0)) + 1) + b
    order = np.argsort(key)
    new = np.zeros(len(key), np.int64)
    new[1:] = np.cumsum(key[order][1:] != key[order][:-1])
    out = np.empty(len(key), np.int64)
    out[order] = new
    return out


def runs_of(flags: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, from, to) of the longest runs of flagged places of each owner; places ascend within an owner."""
    if not len(flags):
        return (np.zeros(0, np.int64),) * 3
    step = np.ones(len(flags), bool)
    step[1:] = (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)
    opens = np.flatnonzero(flags & (step | ~np.concatenate([[False], flags[:-1]])))
    closes = np.flatnonzero(flags & np.concatenate([step[1:] | ~flags[1:], [True]]))
    return owner[opens], place[opens], place[closes] + 1
