"""Best-fit packing into fixed-length sequences, certified by dual-feasible lower bounds."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm import common
from panelspark.llm.tokens import encoder

ROUND, GROUP = 1 << 50, 1 << 24


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each length. Equal lengths are placed in the order given."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, made = 0, 0  # bit r: some bin has r left
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = open_rooms >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            target = room[left].pop()
            if not room[left]:
                open_rooms &= ~(1 << left)
        else:
            left, target, made = capacity, made, made + 1
        bins[i], offsets[i] = target, capacity - left
        if left > size:
            room[left - size].append(target)
            open_rooms |= 1 << (left - size)
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int, folds: int = 8) -> int:
    """The largest bin count that a dual-feasible function proves: no packing needs fewer.

    Each threshold e drops what is shorter than e and rounds what is longer than capacity - e up to a whole bin; the
    rest goes through x -> floor((k + 1) x) / k (x itself where (k + 1) x is whole), for k = 1..folds, or stays as it is.
    All sums are whole numbers over the counts of each length.
    """
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * x).sum()) // capacity)
    low = np.union1d([0], np.flatnonzero(count[: capacity // 2 + 1]))
    high = capacity - low
    for k in range(1, folds + 1):
        whole = (k + 1) * x % capacity == 0
        for unit, image in ((capacity, x), (k * capacity, np.where(whole, x * k, (k + 1) * x // capacity * capacity))):
            total = np.concatenate([[0], np.cumsum(count * image)])
            above = np.concatenate([[0], np.cumsum(count)])
            value = total[high + 1] - total[low] + (above[-1] - above[high + 1]) * unit
            best = max(best, int((-(-value // unit)).max()))
    return best


def _cut(batches: Iterator[pa.RecordBatch], path: str, spaced: bool, end: int, capacity: int) -> Iterator[pa.RecordBatch]:
    enc, last, made = encoder(path, spaced, 4), struct.pack("<I", end), 0
    schema = pa.schema([("uid", pa.int64()), ("doc", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
    for batch in batches:
        for a in range(0, batch.num_rows, 512):
            cols: list[list] = [[], [], [], [], [], []]
            for doc, part, text in zip(*(batch.column(c).slice(a, 512).to_pylist() for c in ("doc", "part", "body"))):
                ids = enc.ids(text or "") + last
                n = len(ids) // 4
                bounds = [0, *range(n - (n - 1) // capacity * capacity, n + 1, capacity)]
                for k, (i, j) in enumerate(zip(bounds, bounds[1:])):
                    for c, v in zip(cols, ((part << 40) + made, doc, k, i, j - i, ids[4 * i : 4 * j])):
                        c.append(v)
                    made += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def token_pieces(docs: DataFrame, tokenizer_path: str, spaced: bool, end_id: int, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, doc, piece, start, length, ids): each text's ids and the end id, cut from its end into pieces of capacity.

    Only the first piece may be shorter. A null or empty text is one piece of one id. Landed once, so uid is stable;
    rows that share an id stay apart.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc"), F.spark_partition_id().cast("long").alias("part"), F.col(text_col).alias("body"))
    schema = "uid long, doc long, piece int, start long, length long, ids binary"
    return common.land(d.mapInArrow(lambda it: _cut(it, tokenizer_path, spaced, end_id, capacity), schema), "pieces", compression="zstd")


def _pack_group(pdf: pd.DataFrame, capacity: int, turn: int) -> pd.DataFrame:
    pdf = pdf.sort_values("uid", ignore_index=True)
    lengths = pdf["length"].to_numpy()
    bins, offsets = best_fit(lengths, capacity)
    fill = np.bincount(bins, lengths)
    gap = len(fill) - lower_bound(lengths, capacity)
    return pd.DataFrame(
        {"uid": pdf["uid"], "length": lengths, "sequence_id": turn * ROUND + pdf["grp"] * GROUP + bins, "offset": offsets, "loose": (gap > 0) & (fill[bins] < capacity)}
    )


def pack(pieces: DataFrame, capacity: int = 2048, group_rows: int = 4096, rounds: int = 3) -> DataFrame:
    """pieces(uid, length <= capacity) -> (uid, length, sequence_id, offset), gapless from 0 in each sequence.

    Whole pieces are sequences of their own. The others are dealt by hash into groups of about group_rows, and each group is
    packed by best-fit decreasing. A group whose bin count equals its lower bound is certified and final. The
    not quite full sequences of groups with a gap are opened: their pieces are dealt anew, so groups exchange
    documents, and packed again; the new packing replaces the old one only if it needs fewer sequences. That
    repeats until all is certified, nothing is gained, or `rounds` are over.
    """
    schema = "uid long, length long, sequence_id long, offset long, loose boolean"
    sequences = lambda df: df.agg(F.count_distinct("sequence_id")).first()[0]

    def dealt(rows: DataFrame, turn: int) -> DataFrame:
        groups = max(1, -(-rows.count() // group_rows))
        grouped = rows.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(groups)).alias("grp")).groupBy("grp")
        return common.land(grouped.applyInPandas(lambda pdf: _pack_group(pdf, capacity, turn), schema), "packed")

    narrow = pieces.select("uid", "length")
    whole = narrow.where(F.col("length") == capacity).select("uid", "length", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    packed = dealt(narrow.where(F.col("length") < capacity), 1)
    final = [whole]
    for turn in range(2, rounds + 2):
        loose = packed.where("loose")
        again = dealt(loose, turn)
        if sequences(again) >= sequences(loose):
            break
        final.append(packed.where("not loose").drop("loose"))
        packed = again
    out = packed.drop("loose")
    for part in final:
        out = out.unionByName(part)
    return out


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return packed_documents(common.table(spark, sf_dir, "documents"))


def packed_documents(docs: DataFrame) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    import public_tokenizers

    pieces = token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), spaced=True, end_id=0)
    placed = pack(pieces).select("uid", "sequence_id", "offset")
    narrow = pieces.select("uid", F.col("doc").alias("doc_id"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return narrow.join(placed, "uid").drop("uid")
