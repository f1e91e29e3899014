"""Static range asymmetric numeral system over token ids: shared table, independent interleaved blocks, checkpoints."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import common
from panelspark.llm.tokens import encoder

MAGIC = b"PSRB"
VERSION = 1
SCALE_BITS = 20
LANES = 1024
CHECK_STEPS = 64
_LOW = np.uint64(1 << 32)
_HEAD = "<4sHHIIIII"  # magic, version, scale bits, lanes, tokens, documents, checkpoints, crc32 of the table


def scaled(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies that sum to 2^bits: a slot for each id that occurs, the others in proportion, what rounding leaves to the most frequent."""
    total, seen = int(counts.sum()), counts > 0
    if seen.sum() > 1 << bits:
        raise ValueError("more distinct ids than slots")
    freq = np.zeros(len(counts), np.int64)
    if total:
        spare = (1 << bits) - int(seen.sum())
        freq[seen] = 1 + (counts[seen].astype(np.float64) / total * spare).astype(np.int64)
        freq[np.argmax(counts)] += (1 << bits) - int(freq.sum())
    return freq


class Table:
    def __init__(self, freq: np.ndarray, bits: int = SCALE_BITS):
        self.bits = bits
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())


def encode_block(ids: np.ndarray, lengths: np.ndarray, table: Table, lanes: int = LANES) -> bytes:
    """One self-contained block: header, document lengths, checkpoints (word offset, crc32 of the ids up to the next one, lane states), words, crc32.

    Id t is in lane t % lanes at step t // lanes. States stay in [2^32, 2^64) and shed 32-bit words. Encoding runs from the last step
    to the first, so the states after encoding a step are what a decoder needs to begin there.
    """
    steps = -(-len(ids) // lanes)
    state = np.full(lanes, _LOW, np.uint64)
    shift = np.uint64(64 - table.bits)
    bits = np.uint64(table.bits)
    chunks, marks, count = [], [], 0
    for step in range(steps - 1, -1, -1):
        part = ids[step * lanes : (step + 1) * lanes]
        x, f = state[: len(part)], table.freq[part]
        full = (x >> shift) >= f
        words = (x[full] & np.uint64(0xFFFFFFFF)).astype("<u4")
        x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        state[: len(part)] = (q << bits) + (x - q * f) + table.start[part]
        chunks.append(words)
        count += len(words)
        if step % CHECK_STEPS == 0:
            crc = zlib.crc32(ids[step * lanes : (step + CHECK_STEPS) * lanes].astype("<u4").tobytes())
            marks.append((count, crc, state.astype("<u8").tobytes()))
    body = [struct.pack(_HEAD, MAGIC, VERSION, table.bits, lanes, len(ids), len(lengths), len(marks), table.crc), lengths.astype("<u4").tobytes()]
    for before, crc, states in reversed(marks):
        body.append(struct.pack("<II", count - before, crc) + states)
    body += [c.tobytes() for c in reversed(chunks)]
    whole = b"".join(body)
    return whole + struct.pack("<I", zlib.crc32(whole))


def decode_block(block: bytes, table: Table, checkpoint: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, document lengths); with a checkpoint, only the ids from it to the next one, without reading those before.

    Raises ValueError for a wrong checksum, table or version.
    """
    if zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("block checksum differs")
    magic, version, bits, lanes, n, docs, checks, crc = struct.unpack_from(_HEAD, block)
    if magic != MAGIC or version != VERSION or crc != table.crc:
        raise ValueError("not a block of this table")
    lengths = np.frombuffer(block, "<u4", docs, struct.calcsize(_HEAD))
    at = struct.calcsize(_HEAD) + 4 * docs
    marks = [(*struct.unpack_from("<II", block, at + k * (8 + 8 * lanes)), at + k * (8 + 8 * lanes) + 8) for k in range(checks)]
    words = np.frombuffer(block[at + checks * (8 + 8 * lanes) : -4], "<u4").astype(np.uint64)
    steps = -(-n // lanes)
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    out = np.empty(n, np.uint32)
    chosen = range(checks) if checkpoint is None else [checkpoint]
    for k in chosen:
        pos, crc, place = marks[k]
        state = np.frombuffer(block, "<u8", lanes, place).astype(np.uint64)
        first, last = k * CHECK_STEPS, min(steps, (k + 1) * CHECK_STEPS)
        for step in range(first, last):
            size = min(lanes, n - step * lanes)
            x = state[:size]
            slot = x & mask
            s = table.symbol[slot]
            x = table.freq[s] * (x >> shift) + slot - table.start[s]
            low = np.flatnonzero(x < _LOW)
            x[low] = (x[low] << np.uint64(32)) | words[pos : pos + len(low)]
            pos += len(low)
            state[:size] = x
            out[step * lanes : step * lanes + size] = s
        if zlib.crc32(out[first * lanes : min(n, last * lanes)].astype("<u4").tobytes()) != crc:
            raise ValueError(f"ids after checkpoint {k} differ")
    if checkpoint is None:
        return out, lengths
    return out[checkpoint * CHECK_STEPS * lanes : min(n, (checkpoint + 1) * CHECK_STEPS * lanes)], lengths


def _tokenize(batches: Iterator[pa.RecordBatch], path: str, spaced: bool, end: int, width: int) -> Iterator[pa.RecordBatch]:
    """Rows -> their ids with the end id; a last row of the task has no document but how often each id occurred, as (id, count) pairs."""
    enc, last, dtype = encoder(path, spaced, width), end.to_bytes(width, "little"), f"<u{width}"
    total, names = np.zeros(0, np.int64), ["doc", "digest", "ids", "counts"]
    for batch in batches:
        for a in range(0, batch.num_rows, 512):
            rows = batch.slice(a, 512)
            made = [enc.ids(t or "") + last for t in rows.column("body").to_pylist()]
            seen = np.bincount(np.frombuffer(b"".join(made), dtype))
            if len(seen) > len(total):
                seen, total = total, seen
            total[: len(seen)] += seen
            yield pa.RecordBatch.from_arrays([rows.column("doc"), rows.column("digest"), pa.array(made, pa.binary()), pa.nulls(len(made), pa.binary())], names)
    at = np.flatnonzero(total)
    pairs = np.stack([at, total[at]], axis=1).astype("<i8").tobytes()
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([pairs], pa.binary())], names)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column("counts").to_pylist():
            pairs = np.frombuffer(raw, "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["id", "n"])


def _encode(batches: Iterator[pa.RecordBatch], freq, block_ids: int, width: int) -> Iterator[pa.RecordBatch]:
    """The rows of an ordered partition become blocks of about block_ids ids; a longer document is a block of its own. pos counts the partition's ids before."""
    table = Table(freq.value)
    schema = pa.schema([("part", pa.int32()), ("pos", pa.int64()), ("n_ids", pa.int64()), ("docs", pa.list_(pa.int64())), ("block", pa.binary())])
    held, size, pos = [], 0, 0

    def block(part: int) -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(h[1] for h in held), f"<u{width}")
        lengths = np.array([len(h[1]) // width for h in held], np.int64)
        return pa.RecordBatch.from_pylist([{"part": part, "pos": pos, "n_ids": len(ids), "docs": [h[0] for h in held], "block": encode_block(ids, lengths, table)}], schema)

    for batch in batches:
        for a in range(0, batch.num_rows, 512):
            rows = batch.slice(a, 512)
            part = rows.column("part")[0].as_py()
            for doc, ids in zip(rows.column("doc").to_pylist(), rows.column("ids").to_pylist()):
                if held and size + len(ids) // width > block_ids:
                    yield block(part)
                    held, size, pos = [], 0, pos + size
                held.append((doc, ids))
                size += len(ids) // width
    if held:
        yield block(part)


def _decode(batches: Iterator[pa.RecordBatch], freq) -> Iterator[pa.RecordBatch]:
    table = Table(freq.value)
    for batch in batches:
        for r in batch.to_pylist():
            ids, lengths = decode_block(r["block"], table)
            ends = np.cumsum(lengths.astype(np.int64))
            begins, raw = ends - lengths, ids.astype("<u4")
            made = [raw[a:b].tobytes() for a, b in zip(begins.tolist(), ends.tolist())]
            cols = [pa.array(r["docs"], pa.int64()), pa.array(r["start"] + begins), pa.array(lengths.astype(np.int64)), pa.array(made, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc", "start", "n_tokens", "ids"])


def write_token_files(
    docs: DataFrame, folder: str, tokenizer_path: str, spaced: bool, end_id: int, id_col: str = "doc_id", text_col: str = "text", block_ids: int = 1 << 18
) -> None:
    """Encode every text, append end_id and write folder/table (id, n), folder/blocks (part, pos, n_ids, docs, block) and folder/parts (part, start).

    Documents stand in ascending id order (null last, ties by a hash of the text); a block begins start + pos ids after the first.
    A null or empty text is the end id alone. Texts are tokenised where they are read and counted in the same pass; ids, two bytes each
    where the vocabulary allows, land in the shared folder, since the frequency table of the whole corpus (a row per id of the
    vocabulary; nothing else reaches the driver but one total per partition) has to be known before the first block. Then ids
    are range-shuffled by id and text hash, so rows without an id, or that share one, spread as well. Blocks share the table and nothing else.
    """
    spark = docs.sparkSession
    width = 2 if max(end_id + 1, encoder(tokenizer_path, spaced, 4).tokenizer.get_vocab_size()) <= 1 << 16 else 4
    d = docs.select(F.col(id_col).cast("long").alias("doc"), common.digest(F.col(text_col)).alias("digest"), F.col(text_col).alias("body"))
    made = d.mapInArrow(lambda it: _tokenize(it, tokenizer_path, spaced, end_id, width), "doc long, digest long, ids binary, counts binary")
    made = common.land(made, "tokens", compression="zstd")
    counts = made.where("counts is not null").select("counts").mapInArrow(_pairs, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts.coalesce(1).write.parquet(f"{folder}/table")
    freq = spark.sparkContext.broadcast(_frequencies(spark, folder))
    order = [F.asc_nulls_last("doc"), F.asc("digest")]
    rows = made.where("counts is null").select("doc", "digest", "ids")
    ordered = rows.repartitionByRange(common.shuffle_partitions(spark), *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "doc", "ids")
    blocks = ordered.mapInArrow(lambda it: _encode(it, freq, block_ids, width), BLOCKS)
    blocks.write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    sizes = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    starts, before = [], 0
    for r in sorted(sizes):
        starts.append((r["part"], before))
        before += r["n"]
    spark.createDataFrame(starts, "part int, start long").coalesce(1).write.parquet(f"{folder}/parts")


BLOCKS = "part int, pos long, n_ids long, docs array<long>, block binary"


def _frequencies(spark: SparkSession, folder: str) -> np.ndarray:
    rows = spark.read.schema("id long, n long").parquet(f"{folder}/table").toPandas()
    counts = np.zeros(1 + int(rows["id"].max() if len(rows) else 0), np.int64)
    counts[rows["id"]] = rows["n"]
    return scaled(counts)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc, start, n_tokens, ids as little-endian unsigned 32-bit numbers) of every document; blocks decode independently."""
    freq = spark.sparkContext.broadcast(_frequencies(spark, folder))
    parts = F.broadcast(spark.read.schema("part int, start long").parquet(f"{folder}/parts"))  # a row per partition of the writer
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").join(parts, "part").select((F.col("start") + F.col("pos")).alias("start"), "docs", "block")
    return blocks.mapInArrow(lambda it: _decode(it, freq), "doc long, start long, n_tokens long, ids binary")


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = common.fresh_folder(spark, "token-files")
    write_token_files(common.table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), spaced=False, end_id=2)
    return read_token_files(spark, folder).select(F.col("doc").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
