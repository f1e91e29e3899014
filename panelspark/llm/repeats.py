"""Passages that start in an earlier document too, found shard by shard: shared plan of substring and suffix-array deduplication.

Every window of T symbols belongs to one segment, and equal windows to segments with equal keys (segments.py).

1. Keys of all segments, four bytes each, meet by hash range; those in two documents fill a bit table of bounded size.
2. The distinct contents of segments that pass it meet the same way: keys with two contents or more, and those with
   very many, are found.
3. Documents land with their passing segments, in chunks. A chunk sends each distinct content once, with its smallest
   document and, where its key has several contents, its text: copies collapse before the shuffle, so a passage
   in a third of all documents costs a row per chunk. A shard (range of keys) takes the minimum document of each content
   and hands the contents of a key to `resolve`, which finds the windows that another content with a smaller
   document has too. Answers go back by chunk and meet the texts,
   which landed in buckets by chunk and are not shuffled.

Filters only spare work: their false positives resolve to nothing and they have no false negatives. A key with more
than `hot_contents` contents is cut into its single windows, each its own key, so no list in a task grows with the corpus.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm import common, words
from panelspark.llm.segments import Prefix, segments

LAST = np.int64((1 << 63) - 1)
_BYTE_SYMBOL = words.mix(np.arange(1, 257, dtype=np.uint64) * words.MIX_A)


class Bytes:
    """Symbols are UTF-8 bytes; what stays is concatenated."""

    block = 1 << 19  # bytes of text whose 64-bit symbols and sums are in memory at once

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf, self.bounds = buf, offsets

    @property
    def symbols(self) -> np.ndarray:
        return _BYTE_SYMBOL[self.buf]

    def text(self, a: int, b: int) -> bytes:
        return self.buf[a:b].tobytes()

    def kept(self, doc: int, gone: np.ndarray) -> bytes:
        return self.buf[self.bounds[doc] : self.bounds[doc + 1]][~gone].tobytes()


class Words:
    """Symbols are words between ASCII white space; what stays is joined by one space."""

    block = 1 << 21

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.starts, self.ends, self.bounds = words.spans(buf, offsets)
        self.symbols = words.word_hashes(buf, self.starts, self.ends)
        self.raw = buf.tobytes()

    def text(self, a: int, b: int) -> bytes:
        return b" ".join(self.raw[self.starts[a] : self.ends[b - 1]].split())

    def kept(self, doc: int, gone: np.ndarray) -> bytes:
        a, b = self.bounds[doc], self.bounds[doc + 1]
        if a == b:
            return b""
        all_words = self.raw[self.starts[a] : self.ends[b - 1]].split()
        return b" ".join(all_words if not gone.any() else [w for w, g in zip(all_words, gone.tolist()) if not g])


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    """Document ids; a missing one counts as later than all others."""
    return batch.column("doc").fill_null(int(LAST)).to_numpy().astype(np.int64)


def _split(keys: np.ndarray, shards: int) -> np.ndarray:
    """Bounds of the 2^shards equal ranges in sorted keys."""
    return np.searchsorted(keys >> np.uint64(64 - shards), np.arange((1 << shards) + 1).astype(np.uint64))


def _short(keys: np.ndarray, shards: int) -> np.ndarray:
    """The 32 bits after those that name the shard."""
    return ((keys << np.uint64(shards)) >> np.uint64(32)).astype(np.uint32)


def _passes(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Bits of the table at the keys' leading bits."""
    at = keys >> np.uint64(64 - (len(table).bit_length() - 1 + 3))
    return (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _packed(shards: int, keys: np.ndarray, contents: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """One row per shard with its part of the ascending keys, 32 bits each, and of the contents, 48 bits each."""
    cut = _split(keys, shards)
    full = np.flatnonzero(np.diff(cut)).tolist()
    if full:
        part = [slice(cut[i], cut[i + 1]) for i in full]
        columns = {"shard": pa.array(full, pa.int32()), "keys": pa.array([_press(_gaps(_short(keys[s], shards))) for s in part], pa.binary())}
        if contents is not None:
            columns["contents"] = pa.array([_press(contents[s] >> np.uint64(16)) for s in part], pa.binary())
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _unpacked(column: pa.ChunkedArray, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype) for x in column.to_pylist()]


def _press(data: np.ndarray) -> bytes:
    """Compressed byte planes: the high bytes of small numbers cost nothing."""
    return zstandard.compress(np.ascontiguousarray(data).view(np.uint8).reshape(len(data), -1).T.tobytes() if len(data) else b"", 3)


def _release(data: bytes, dtype) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def _gaps(ascending: np.ndarray) -> np.ndarray:
    out = ascending.copy()
    out[1:] -= ascending[:-1]
    return out


def _released(column: pa.ChunkedArray, dtype, gaps: bool = False) -> list[np.ndarray]:
    out = [_release(x, dtype) for x in column.to_pylist()]
    return [np.cumsum(x, dtype=dtype) for x in out] if gaps else out


def _give_back() -> None:
    """Return freed memory to the system: workers outlive their tasks and share the executor's limit."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


class Finder:
    def __init__(self, kind: type, window: int, gram: int, resolve: Callable, hot_contents: int, chunk_bytes: int):
        self.kind, self.window, self.gram, self.resolve = kind, window, gram, resolve
        self.hot_contents, self.chunk_bytes = hot_contents, chunk_bytes

    def _scan(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(source batch rows, document ids, symbol view, key, start, windows, content, document index) per block of text."""
        for batch in batches:
            ids = _ids(batch)
            for a, b, buf, offsets in words.text_blocks(batch, "body", self.kind.block):
                view = self.kind(buf, offsets)
                key, start, count, content = segments(view.symbols, view.bounds, self.window, self.gram)
                of = np.searchsorted(view.bounds, start, side="right") - 1
                yield batch.slice(a, b - a), ids[a:b], (view, buf, offsets), key, start, count, content, of

    # 1: keys in two documents
    def keys(self, batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for last in (False, True):
            for _, ids, _, key, _, _, _, of in self._scan(batches) if not last else [(None,) * 8]:
                if key is not None:
                    held.append((key, ids[of]))
                    size += len(key)
                if held and (last or size > 4_000_000):
                    key, doc = map(np.concatenate, zip(*held))
                    order = np.argsort(key)
                    key, doc = key[order], doc[order]
                    opens = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                    two = np.minimum.reduceat(doc, opens) != np.maximum.reduceat(doc, opens) if len(key) else np.zeros(0, bool)
                    key = key[opens]
                    twice = np.repeat(key, 1 + two)  # a key in two documents of the task is sent twice
                    yield from _packed(shards, twice)
                    held, size = [], 0

    @staticmethod
    def shared(table: pa.Table) -> pa.Table:
        key = np.sort(np.concatenate(_released(table.column("keys"), np.uint32, gaps=True)))
        key = np.unique(key[1:][key[1:] == key[:-1]])
        return pa.table({"shard": table.column("shard").slice(0, 1), "n": [len(key)], "keys": pa.array([key.tobytes()], pa.binary())})

    # 2: keys with several contents
    def contents(self, batches: Iterator[pa.RecordBatch], shards: int, table) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for last in (False, True):
            for _, _, _, key, _, _, content, _ in self._scan(batches) if not last else [(None,) * 8]:
                if key is not None:
                    ok = _passes(key, table.value)
                    held.append((key[ok], content[ok]))
                    size += int(ok.sum())
                if held and (last or size > 4_000_000):
                    key, content = map(np.concatenate, zip(*held))
                    order = np.lexsort((content, key))
                    key, content = key[order], content[order]
                    new = np.ones(len(key), bool)
                    new[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
                    yield from _packed(shards, key[new], content[new])
                    held, size = [], 0

    def several(self, table: pa.Table) -> pa.Table:
        key = np.concatenate(_released(table.column("keys"), np.uint32, gaps=True))
        content = np.concatenate(_released(table.column("contents"), np.uint64))
        order = np.lexsort((content, key))
        key, content = key[order], content[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
        key, n = np.unique(key[new], return_counts=True)
        several, hot = key[n > 1], key[n > self.hot_contents]
        return pa.table(
            {"shard": table.column("shard").slice(0, 1), "n": [len(several)], "keys": pa.array([several.tobytes()], pa.binary()), "hot": pa.array([hot.tobytes()], pa.binary())}
        )

    # 3: chunks of documents and what they ask of the shards
    def chunks(self, batches: Iterator[pa.RecordBatch], shards: int, shared, several, hot) -> Iterator[pa.RecordBatch]:
        held, size, made = [], 0, 0
        for rows, ids, (view, buf, offsets), *found in self._scan(batches):
            ok = np.flatnonzero(_passes(found[0], shared.value))
            held.append((rows.select(["doc", "part"]), ids, (view, buf, offsets), *(x[ok] for x in found)))
            size += len(buf)
            if size >= self.chunk_bytes:
                yield from self._chunk(held, made, shards, several.value, hot.value)
                held, size, made = [], 0, made + 1
        if held:
            yield from self._chunk(held, made, shards, several.value, hot.value)

    def _chunk(self, held: list, made: int, shards: int, several: np.ndarray, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = []
        for i, (_, ids, (view, _, _), key, start, count, content, of) in enumerate(held):
            many = _passes(key, several)
            cut = np.isin(key >> np.uint64(32 - shards), hot)
            if cut.any():
                each = np.repeat(np.flatnonzero(cut), count[cut])
                first = start[each] + np.arange(len(each)) - np.repeat(np.cumsum(count[cut]) - count[cut], count[cut])
                single = Prefix(view.symbols).runs(first, first + self.window)
                rest = ~cut
                key = np.concatenate([key[rest], words.mix(single)])
                content = np.concatenate([content[rest], single])
                start, of = np.concatenate([start[rest], first]), np.concatenate([of[rest], of[each]])
                count, many = np.concatenate([count[rest], np.ones(len(each), np.int64)]), np.concatenate([many[rest], np.zeros(len(each), bool)])
            found.append((np.full(len(key), i), key, start, count, content, of, ids[of], many))
        block, key, start, count, content, of, doc, many = map(np.concatenate, zip(*found))
        # Distinct contents, numbered in key order.
        order = np.lexsort((doc, content, key))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (content[order][1:] != content[order][:-1])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        lead = order[new]  # the first of each content has its smallest document
        part = held[0][0].column("part")[0].as_py()
        chunk = (part << 20) + made
        texts = [held[b][2][0].text(a, a + n + self.window - 1) if m else b"" for b, a, n, m in zip(block[lead].tolist(), start[lead].tolist(), count[lead].tolist(), many[lead].tolist())]
        cut = _split(key[lead], shards)
        full = np.flatnonzero(np.diff(cut)).tolist()
        span = [slice(cut[i], cut[i + 1]) for i in full]
        sizes = np.array([len(t) for t in texts], np.int32)
        asks = {
            "shard": pa.array(full, pa.int32()), "chunk": pa.array([chunk] * len(full), pa.int64()), "base": pa.array([int(cut[i]) for i in full], pa.int64()),
            "keys": pa.array([_press(_gaps(key[lead][s])) for s in span], pa.binary()),
            "contents": pa.array([_press(np.where(many[lead][s], content[lead][s], np.uint64(0))) for s in span], pa.binary()),
            "firsts": pa.array([_press(doc[lead][s]) for s in span], pa.binary()), "sizes": pa.array([_press(sizes[s]) for s in span], pa.binary()),
            "texts": pa.array([_press(np.frombuffer(b"".join(texts[s]), np.uint8)) for s in span], pa.binary()),
        }
        yield _row(asks, len(full), 0)
        for i, (rows, ids, (view, buf, offsets), *_) in enumerate(held):
            mine = np.flatnonzero(block == i)
            mine = mine[np.lexsort((start[mine], of[mine]))]
            ids = rows.column("doc")
            parts = {
                "docs": ids.fill_null(0).to_numpy(), "missing": ids.is_null().to_numpy(zero_copy_only=False), "offsets": offsets, "body": buf, "cuts": np.searchsorted(of[mine], np.arange(len(ids) + 1)),
                "numbers": number[mine].astype(np.int32), "starts": (start[mine] - view.bounds[of[mine]]).astype(np.int32), "counts": count[mine].astype(np.int32),
            }
            yield _row({"chunk": pa.array([chunk], pa.int64())} | {k: pa.array([_press(v)], pa.binary()) for k, v in parts.items()}, 1, 1)
        _give_back()

    # A shard's answer: for each content of a chunk its first document, and the windows of it that an earlier one has
    def answer(self, table: pa.Table) -> pa.Table:
        keys = _released(table.column("keys"), np.uint64, gaps=True)
        rows, key = np.array([len(k) for k in keys]), np.concatenate(keys)
        content = np.concatenate(_released(table.column("contents"), np.uint64))
        first = np.concatenate(_released(table.column("firsts"), np.int64))
        sizes = np.concatenate(_released(table.column("sizes"), np.int32)).astype(np.int64)
        order = np.lexsort((content, key))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (content[order][1:] != content[order][:-1])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        lead = order[new]
        low = np.minimum.reduceat(first[order], np.flatnonzero(new))
        runs = self._runs([zstandard.decompress(t) for t in table.column("texts").to_pylist()], rows, key[lead], lead, sizes, low)
        at_of, from_of, to_of = runs
        bounds = np.concatenate([[0], np.cumsum(rows)])
        has = np.searchsorted(at_of, np.arange(len(low) + 1))
        out = {"chunk": table.column("chunk"), "base": table.column("base"), "firsts": [], "ats": [], "froms": [], "tos": []}
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            g = group[a:b]
            n = has[g + 1] - has[g]
            pick = np.repeat(has[g], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out["firsts"].append(_press(low[g]))
            out["ats"].append(_press(np.repeat(np.arange(b - a), n).astype(np.int32)))
            out["froms"].append(_press(from_of[pick].astype(np.int32)))
            out["tos"].append(_press(to_of[pick].astype(np.int32)))
        _give_back()
        return pa.table({k: v if k in ("chunk", "base") else pa.array(v, pa.binary()) for k, v in out.items()})

    def _runs(self, texts: list[bytes], rows: np.ndarray, key: np.ndarray, lead: np.ndarray, sizes: np.ndarray, low: np.ndarray, most: int = 1 << 17) -> tuple:
        """(content, from, to) runs of windows that another content has in an earlier document, by groups of whole keys."""
        rows = np.repeat(np.arange(len(texts)), rows)
        total = np.cumsum(sizes) - sizes
        within = total - np.concatenate([[0], np.cumsum([len(t) for t in texts])])[rows]
        alone = np.ones(len(key), bool)
        alone[1:] &= key[1:] != key[:-1]
        alone[:-1] &= key[:-1] != key[1:]
        todo = np.flatnonzero(~alone & (sizes[lead] > 0))
        opens = np.ones(len(todo), bool)
        opens[1:] = key[todo][1:] != key[todo][:-1]
        starts = np.flatnonzero(opens)
        weight = np.concatenate([[0], np.cumsum(sizes[lead[todo]])])
        out, a = [(np.zeros(0, np.int64),) * 3], 0
        while a < len(todo):
            ends = np.append(starts[starts > a], len(todo))
            b = int(ends[max(0, np.searchsorted(weight[ends], weight[a] + most, side="right") - 1)])
            g = todo[a:b]
            parts = [texts[rows[i]][within[i] : within[i] + sizes[i]] for i in lead[g].tolist()]
            at, lo, hi = self.resolve(parts, low[g], self.window)
            out.append((g[at], lo, hi))
            a = b
        at, lo, hi = map(np.concatenate, zip(*out))
        order = np.lexsort((lo, at))
        return at[order], lo[order], hi[order]

    def finish(self, blocks: pa.Table, answers: pa.Table) -> Iterator[pa.RecordBatch]:
        """Texts of one chunk with the shards' answers -> what goes and what stays of each document."""
        first, begin, runs = np.zeros(0, np.int64), np.zeros(1, np.int64), (np.zeros(0, np.int64),) * 2
        if answers.num_rows:
            base = answers.column("base").to_numpy()
            parts = [_released(answers.column(c), t) for c, t in (("firsts", np.int64), ("ats", np.int32), ("froms", np.int32), ("tos", np.int32))]
            by = np.argsort(base).tolist()
            first = np.concatenate([parts[0][i] for i in by])
            at = np.concatenate([parts[1][i] + base[i] for i in by])
            begin = np.searchsorted(at, np.arange(len(first) + 1))
            runs = np.concatenate([parts[2][i] for i in by]), np.concatenate([parts[3][i] for i in by])
        for row in blocks.to_pylist():
            docs, offsets, cuts = (_release(row[c], np.int64) for c in ("docs", "offsets", "cuts"))
            missing = _release(row["missing"], bool)
            number, start, count = (_release(row[c], np.int32).astype(np.int64) for c in ("numbers", "starts", "counts"))
            view = self.kind(_release(row["body"], np.uint8), offsets)
            of = np.repeat(np.arange(len(docs)), np.diff(cuts))
            start = start + view.bounds[of]
            edge = np.zeros(int(view.bounds[-1]) + 1, np.int32)
            if len(number):
                whole = first[number] < np.where(missing, LAST, docs)[of]
                np.add.at(edge, start[whole], 1)
                np.add.at(edge, start[whole] + count[whole] + self.window - 1, -1)
                rest = np.flatnonzero(~whole)
                n = begin[number[rest] + 1] - begin[number[rest]]
                pick = np.repeat(begin[number[rest]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                np.add.at(edge, np.repeat(start[rest], n) + runs[0][pick], 1)
                np.add.at(edge, np.repeat(start[rest], n) + runs[1][pick] + self.window - 1, -1)
            gone = np.cumsum(edge[:-1]) > 0
            # Runs that touch at the edge of two documents are two spans.
            where = np.concatenate([[False], gone, [False]])
            opens, closes = where[1:-1] & ~where[:-2], where[1:-1] & ~where[2:]
            heads = view.bounds[:-1][np.diff(view.bounds) > 0]
            opens[heads] |= gone[heads]
            tails = view.bounds[1:][np.diff(view.bounds) > 0] - 1
            closes[tails] |= gone[tails]
            begins, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
            inside = np.searchsorted(view.bounds, begins, side="right") - 1
            each = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(inside, np.arange(len(docs) + 1)).astype(np.int32)),
                pa.StructArray.from_arrays([pa.array(begins - view.bounds[inside]), pa.array(ends - view.bounds[inside])], ["start", "end"]),
            )
            kept = [view.kept(i, gone[a:b]) for i, (a, b) in enumerate(zip(view.bounds[:-1].tolist(), view.bounds[1:].tolist()))]
            cols = [pa.array(docs, mask=missing), pa.array(np.diff(view.bounds)), pa.array(words.per_document(gone, view.bounds)), each, pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, schema=_out_schema())


_ASKS = ("keys", "contents", "firsts", "sizes", "texts")
_TEXTS = ("docs", "missing", "offsets", "body", "cuts", "numbers", "starts", "counts")
_LANDED = {"shard": pa.int32(), "chunk": pa.int64(), "base": pa.int64()} | dict.fromkeys(_ASKS + _TEXTS, pa.binary())
_SCHEMA = "kind int, shard int, chunk long, base long, " + ", ".join(f"{c} binary" for c in _ASKS + _TEXTS)
_OUT = "doc long, n_symbols long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"


def _row(columns: dict, n: int, kind: int) -> pa.RecordBatch:
    cols = [pa.array([kind] * n, pa.int32())]
    cols += [columns[c].cast(t) if c in columns else pa.nulls(n, t) for c, t in _LANDED.items()]
    return pa.RecordBatch.from_arrays(cols, ["kind", *_LANDED])


def _bit_table(found: DataFrame, shards: int, most_bits: int) -> np.ndarray:
    """Bits at the leading bits of the keys in found(shard, n, keys): 16 per key, at most 2^most_bits in all."""
    n = found.agg(F.sum("n")).first()[0] or 0
    bits = min(most_bits, max(shards + 3, int(16 * n).bit_length()))
    part = bits - shards

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key in _unpacked(batch.column("keys"), np.uint32):
                on = np.zeros(1 << part, np.uint8)
                on[key >> np.uint32(32 - part)] = 1
                rows.append(np.packbits(on, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array(rows, pa.binary())], ["shard", "bits"])

    table = np.zeros(1 << bits - 3, np.uint8)
    for r in found.select("shard", "keys").mapInArrow(fill, "shard int, bits binary").toLocalIterator():
        table[r["shard"] << part - 3 : (r["shard"] + 1) << part - 3] = np.frombuffer(r["bits"], np.uint8)
    return table


def repeated_windows(
    docs: DataFrame, kind: type, window: int, gram: int, resolve: Callable, id_col: str = "doc_id", text_col: str = "text",
    hot_contents: int = 8192, chunk_bytes: int = 8 << 20, most_bits: int = 30,
) -> DataFrame:
    """Per row: doc, n_symbols, n_removed, spans (maximal runs of removed symbols) and kept (bytes).

    A symbol goes if a window of `window` symbols over it also starts in a document with a smaller id, judged on the
    input. A null text has no symbols; a missing id counts as larger than all others; rows that share an id are not
    earlier than each other, so repeated rows give equal results. Equality of windows is that of 128 bits of
    hash, and of the symbols themselves where a key has several contents.
    """
    spark = docs.sparkSession
    finder = Finder(kind, window, gram, resolve, hot_contents, chunk_bytes)
    shards = max(4, min(16, (common.shuffle_partitions(spark) - 1).bit_length()))
    d = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("body"), F.spark_partition_id().cast("long").alias("part"))
    # A number given here keeps small shards from being merged into one task.
    n = common.shuffle_partitions(spark)
    found = d.mapInArrow(lambda it: finder.keys(it, shards), "shard int, keys binary").repartition(n, "shard").groupBy("shard").applyInArrow(lambda t: finder.shared(t), "shard int, n long, keys binary")
    shared = spark.sparkContext.broadcast(_bit_table(common.land(found, "shared"), shards, most_bits))
    found = d.mapInArrow(lambda it: finder.contents(it, shards, shared), "shard int, keys binary, contents binary")
    found = common.land(found.repartition(n, "shard").groupBy("shard").applyInArrow(lambda t: finder.several(t), "shard int, n long, keys binary, hot binary"), "several")
    several = spark.sparkContext.broadcast(_bit_table(found, shards, most_bits))
    hot = [(np.uint64(r["shard"]) << np.uint64(32)) | np.frombuffer(r["hot"], np.uint32).astype(np.uint64) for r in found.where("length(hot) > 0").select("shard", "hot").toLocalIterator()]
    hot = spark.sparkContext.broadcast(np.concatenate(hot) if hot else np.zeros(0, np.uint64))
    made = d.mapInArrow(lambda it: finder.chunks(it, shards, shared, several, hot), _SCHEMA)
    landed = common.land_buckets(made, "chunks", "chunk", by="kind", compression="uncompressed")
    asks = landed.where("kind = 0").select("shard", F.col("chunk").alias("chunk"), "base", *_ASKS)
    answers = asks.repartition(n, "shard").groupBy("shard").applyInArrow(lambda t: finder.answer(t), "chunk long, base long, firsts binary, ats binary, froms binary, tos binary")
    both = landed.where("kind = 1").select("chunk", *_TEXTS).groupBy("chunk").cogroup(answers.groupBy("chunk"))
    return both.applyInArrow(lambda rows, got: pa.Table.from_batches(list(finder.finish(rows, got)), schema=_out_schema()), _OUT)


def _out_schema() -> pa.Schema:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.schema([("doc", pa.int64()), ("n_symbols", pa.int64()), ("n_removed", pa.int64()), ("spans", span), ("kept", pa.binary())])
