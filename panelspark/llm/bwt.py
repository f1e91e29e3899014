"""Suffix-array deduplication: Burrows-Wheeler transforms of shards, merged by iterative interleave refinement."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm import common
from panelspark.llm.repeats import LAST, Bytes, repeated_windows
from panelspark.llm.rotations import Rotations, runs_of
from panelspark.llm.words import eights


def strided(texts: list[bytes], step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each text as `step` strings of step-byte symbols, one per phase: (symbols, string lengths, text, byte place).

    The string of phase r reads bytes r, r + step, ...; so the first k symbols at a place are its next k * step bytes.
    Symbols are numbered from 1 in byte order.
    """
    buf = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    phase = np.tile(np.arange(step), len(texts))
    text = np.repeat(np.arange(len(texts)), step)
    lengths = (size[text] - phase) // step
    string = np.repeat(np.arange(len(text)), lengths)
    k = np.arange(int(lengths.sum())) - (np.cumsum(lengths) - lengths)[string]
    place = phase[string] + k * step
    at = (np.cumsum(size) - size)[text[string]] + place
    value = (eights(buf)[at] & np.uint64((1 << 8 * step) - 1)).byteswap() >> np.uint64(64 - 8 * step)
    _, symbol = np.unique(value, return_inverse=True)
    return symbol.astype(np.int64) + 1, lengths, text, place


class Shard:
    """Sorted rotations of some strings, to a depth: the order and the symbol before each."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, depth: int, code: type):
        self.rot = Rotations(symbols, lengths)
        rank, _ = self.rot.ranks(depth)
        self.order = np.argsort(rank, kind="stable")
        self.bwt = self.rot.symbol[self.rot.prev[self.order]].astype(code)


def merge(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(interleave, lcp): which transform each merged row comes from, and the common prefix of each row with the one before, up to depth.

    Round k reads the transforms in the order of the last interleave and deals each row's source to its symbol's bucket, which orders
    the merged rows by k symbols. A row opens a new block when its symbol or its successor's block differs from the
    row before; the round in which that happens gives the common prefix. No suffix is looked at.
    """
    whole = np.concatenate(transforms)
    source = np.repeat(np.arange(len(transforms), dtype=np.uint8), [len(t) for t in transforms])
    merged = source
    block = np.zeros(len(whole), np.int32)
    lcp = np.full(len(whole), depth, np.int32)
    for k in range(depth):
        symbol = np.empty_like(whole)
        symbol[np.argsort(merged, kind="stable")] = whole
        deal = np.argsort(symbol, kind="stable")
        merged, symbol, block = merged[deal], symbol[deal], block[deal]
        opens = np.ones(len(whole), bool)
        opens[1:] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        lcp[opens & (lcp == depth)] = k
        block = np.cumsum(opens, dtype=np.int32)
    return merged, lcp


def resolve_bytes(texts: list[bytes], first_docs: np.ndarray, window: int, shards: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that start in an earlier document than the text's first, from blocks of equal prefixes in the merged order."""
    for step in (s for s in range(5, 0, -1) if window % s == 0):
        symbols, lengths, text, place = strided(texts, step)
        if int(symbols.max(initial=0)) < 1 << 16:
            break
    code, depth = (np.uint16 if int(symbols.max(initial=0)) < 1 << 16 else np.int64), window // step
    ends = np.cumsum(lengths)
    cut = np.unique(np.linspace(0, len(lengths), min(shards, len(lengths)) + 1).astype(np.int64))
    parts, node_text, node_place = [], [], []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        lo = int(ends[a] - lengths[a])
        shard = Shard(symbols[lo : int(ends[b - 1])], lengths[a:b], depth, code)
        parts.append(shard.bwt)
        rot = shard.rot
        node_text.append(text[a:b][rot.owner][shard.order])
        node_place.append((rot.place * step + (np.arange(a, b) % step)[rot.owner])[shard.order])
    merged, lcp = merge(parts, depth)
    row = np.argsort(merged, kind="stable")
    node_text, node_place = np.concatenate(node_text), np.concatenate(node_place)
    size = np.array([len(t) for t in texts], np.int64)
    whole = node_place + window <= size[node_text]
    doc = np.empty(len(row), np.int64)
    doc[row] = np.where(whole, first_docs[node_text], LAST)
    opens = lcp < depth
    low = np.minimum.reduceat(doc, np.flatnonzero(opens))[np.cumsum(opens) - 1][row]
    order = np.lexsort((node_place, node_text))
    order = order[whole[order]]
    return runs_of((low < first_docs[node_text])[order], node_text[order], node_place[order])


def repeated_substrings(docs: DataFrame, window: int = 50, gram: int = 20, **options) -> DataFrame:
    """Rows of repeated_windows over UTF-8 bytes: spans of byte positions, kept bytes."""
    return repeated_windows(docs, Bytes, window, gram, resolve_bytes, **options)


def op8_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    found = repeated_substrings(common.table(spark, sf_dir, "documents"))
    return found.select(
        F.col("doc").alias("doc_id"), F.col("n_symbols").alias("n_bytes"), "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
