"""Vectorised words of Arrow text columns: spans, 64-bit hashes, n-grams. Runs inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MIX_A = np.uint64(0x9E3779B97F4A7C15)
MIX_B = np.uint64(0xD6E8FEB86659FD93)
_BYTE = np.arange(256)
#: Bytes of words split at ASCII white space, and of words made of ASCII letters, digits and all other code points.
IS_WORD = ~((_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13)))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * MIX_B
    x = (x ^ (x >> np.uint64(29))) * MIX_A
    return x ^ (x >> np.uint64(32))


def text_blocks(batch: pa.RecordBatch, column: str, max_bytes: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of slices with about max_bytes of UTF-8 text; a longer text is a slice of its own."""
    texts = pc.fill_null(batch.column(column), "").cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + max_bytes, side="right")) - 1)
        b = min(b, len(texts))
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def spans(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in bytes, and the index of each document's first word (one more at the end)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = is_word[buf]
    edge = offsets[offsets < len(buf)]
    left = np.empty_like(inside)
    left[0], left[1:] = False, inside[:-1]
    left[edge] = False
    right = np.empty_like(inside)
    right[-1], right[:-1] = False, inside[1:]
    right[edge[edge > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~left), np.flatnonzero(inside & ~right) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def eights(buf: np.ndarray) -> np.ndarray:
    """Entry i: the eight bytes from i as one little-endian number, zeros beyond the end."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray(shape=(len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, from its bytes alone."""
    size = ends - starts
    if not len(size):
        return np.zeros(0, np.uint64)
    eight = eights(buf)
    masks = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
    out = mix((eight[starts] & masks[np.minimum(size, 8)]) + size.astype(np.uint64) * MIX_A)
    more, at = np.flatnonzero(size > 8), 8
    while len(more):
        part = eight[starts[more] + at] & masks[np.minimum(size[more] - at, 8)]
        out[more] = mix(out[more] * MIX_A + part)
        at += 8
        more = more[size[more] > at]
    return out


def ngrams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of one document, and the index of their first word."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = len(hashes) - n + 1
    gram = hashes[:size].copy()
    for k in range(1, n):
        gram = mix(gram * MIX_A + hashes[k : k + size])
    last = np.repeat(first[1:], np.diff(first))[:size]
    at = np.flatnonzero(np.arange(size) + n <= last)
    return gram[at], at


def per_document(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive bounds."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]
