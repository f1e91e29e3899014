"""SimHash near-duplicates with pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm import common, words

SEED = 42
_ONE = np.uint64(1)


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of each run of `shingle` words; of the whole where there are fewer, none without words."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    n = max(1, len(tokens) - shingle + 1)
    starts = np.zeros(len(tokens), np.int64)
    starts[1:] = np.cumsum([len(w) + 1 for w in tokens[:-1]])
    ends = np.append(starts[1:] - 1, len(joined))[min(shingle, len(tokens)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends.tolist())], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """64-bit SimHash of hashes; 0 of none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, buf, offsets in words.text_blocks(batch, "body"):
            whole = buf.tobytes()
            fp = np.array([majority(shingle_hashes(whole[i:j], shingle)) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())], dtype=np.uint64).view(np.int64)
            cols = [batch.column(c).slice(a, b - a) for c in batch.schema.names if c != "body"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(fp)], [*(c for c in batch.schema.names if c != "body"), "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Per row: doc and fp (64 bits as a signed long).

    A-Z are lower-cased, words split at ASCII white space, and a bit is set if more than half of the
    shingles' XXH64 have it. Repeats count. A text with fewer words than a shingle is one shingle; without words all bits are 0.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("body"))
    return d.mapInArrow(lambda it: _fingerprints(it, shingle), "doc long, fp long")


def _turn(bits: np.ndarray, right: np.uint64) -> np.ndarray:
    return bits if not right else (bits >> right) | (bits << (np.uint64(64) - right))


def chain_holds(diff: np.ndarray, ring: int, boxes: int, limit: int) -> np.ndarray:
    """The strong pigeonring condition from box `ring`: each prefix of the ring of boxes has at most its proportional share of limit."""
    width = 64 // boxes
    turned = _turn(diff, np.uint64(ring * width))
    ok = np.ones(len(diff), bool)
    for k in range(1, boxes + 1):
        ok &= np.bitwise_count(turned & np.uint64((1 << width * k) - 1)) <= limit * k // boxes
    return ok


def _ring_keys(batches: Iterator[pa.RecordBatch], boxes: int, limit: int, probe: bool) -> Iterator[pa.RecordBatch]:
    """Per fingerprint and ring position its own key (side 0) and, to probe, every key within the budget of the first two boxes (side 1).

    boxes > limit leaves no differing bit to the first box and 2 * limit // boxes, so 0 or 1, to the first two.
    """
    width = 64 // boxes
    flips = [0] + [1 << j for j in range(width, 2 * width)] * (2 * limit // boxes)
    for batch in batches:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        for ring in range(boxes):
            own = (_turn(fp, np.uint64(ring * width)) & np.uint64((1 << 2 * width) - 1)).astype(np.int64) | (ring << 2 * width)
            for side, flip in ((0, 0), *((1, f) for f in flips if probe)):
                yield pa.RecordBatch.from_arrays([pa.array(own ^ flip), pa.array(np.full(len(fp), side, np.int8)), batch.column("fp")], ["key", "side", "fp"])


def _verify(batches: Iterator[pa.RecordBatch], boxes: int, limit: int, block: int = 2048) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, part and side: a run of side-0 rows (bounded by the parts) is held while its side-1 rows stream past."""
    width = 64 // boxes
    held_at, held = None, np.zeros(0, np.uint64)
    for batch in batches:
        if not batch.num_rows:
            continue
        key, part, side = (batch.column(c).to_numpy() for c in ("key", "part", "side"))
        fp = batch.column("fp").to_numpy().view(np.uint64)
        group = np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
        run = group | np.concatenate([[True], side[1:] != side[:-1]])
        first = np.flatnonzero(run)
        end = np.append(first[1:], len(key))
        follows = ~group[first] & (side[first] == 1)
        # A single indexed row met by its own probe alone cannot pair; nearly all keys are like that.
        size = end - first
        idle = follows.copy()
        idle[1:] &= (size[1:] == 1) & (size[:-1] == 1) & (fp[first[1:]] == fp[first[:-1]])
        idle[:2] = idle[-1:] = False
        work = np.flatnonzero(follows & ~idle).tolist()
        continued = held_at == (int(key[0]), int(part[0]))
        if continued and side[0] == 0:
            held = np.concatenate([held, fp[: end[0]]])
        elif continued:
            work = [0, *work]
        left, right = [], []
        for r in work:
            index = held if r == 0 or (r == 1 and continued) else fp[first[r - 1] : end[r - 1]]
            ring = int(key[first[r]]) >> 2 * width
            for s in range(first[r], end[r], block):
                probe = fp[s : min(end[r], s + block)]
                i, j = np.nonzero(np.bitwise_count(probe[:, None] ^ index[None, :]) <= limit)
                near = index[j] < probe[i]
                i, j = i[near], j[near]
                near = chain_holds(probe[i] ^ index[j], ring, boxes, limit)
                left.append(probe[i[near]])
                right.append(index[j[near]])
        last = len(first) - 1
        if not (last == 0 and continued):
            if side[first[last]] == 0:
                held_at, held = (int(key[-1]), int(part[-1])), fp[first[last] :].copy()
            elif follows[last]:
                if not (last == 1 and continued):
                    held = fp[first[last - 1] : end[last - 1]].copy()
                held_at = (int(key[-1]), int(part[-1]))
            else:
                held_at = None
        if sum(map(len, left)):
            a, b = _forest(np.concatenate(left), np.concatenate(right))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars that connect what the pairs connect: at most one row per value instead of one per pair."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        root = root[root]
        if np.array_equal(root, before):
            break
    at = np.flatnonzero(root != np.arange(len(ids)))
    return ids[at], ids[root[at]]


def hamming_forest(fps: DataFrame, limit: int = 3, part_rows: int = 4096) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints of fps(fp, distinct) at most `limit` bits apart.

    Pigeonring: with more boxes than limit, a pair within the limit has a box from which every run of boxes
    stays within its proportional budget. The first two boxes of that chain give the join key, the longer
    prefixes prune candidates before the whole distance counts. Every fingerprint is indexed under one key per ring
    position and probes every key its budget reaches. A key with more than part_rows fingerprints is cut into parts by hash
    and its probes go to each part, so a task holds a bounded list; inside a task pairs shrink to a spanning forest.
    """
    boxes = next(b for b in (2, 4, 8, 16, 32) if b > limit)
    schema = "key long, side byte, fp long"
    own = fps.select("fp").mapInArrow(lambda it: _ring_keys(it, boxes, limit, False), schema)
    big = own.groupBy("key").count().where(F.col("count") > part_rows)
    big = common.land(big.select("key", F.ceil(F.col("count") / part_rows).cast("int").alias("parts")), "simhash-big")
    rows = fps.select("fp").mapInArrow(lambda it: _ring_keys(it, boxes, limit, True), schema)
    rows = rows.join(big, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    every = F.when(F.col("side") == 0, F.array(mine)).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = rows.select("key", "side", "fp", F.explode(every).alias("part"))
    dealt = rows.repartition(common.shuffle_partitions(fps.sparkSession), "key", "part").sortWithinPartitions("key", "part", "side")
    return dealt.mapInArrow(lambda it: _verify(it, boxes, limit), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, limit: int = 3) -> DataFrame:
    """Per row: doc, fp, component (smallest doc reachable over links of at most `limit` bits, itself included).

    Rows with one fingerprint are one node, so copies never pair; texts without words share fingerprint 0 and link
    like any other. A row without an id joins its component and does not name it.
    """
    made = common.land(fingerprints(docs, id_col, text_col, shingle), "simhash")
    nodes = common.land(made.groupBy("fp").agg(F.min("doc").alias("rep")), "simhash-nodes")
    roots = common.components(hamming_forest(nodes, limit))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("rep").alias("component")), "root").select("fp", "component")
    return made.select("doc", "fp").join(named, "fp").select("doc", "fp", "component")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
