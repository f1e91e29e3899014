"""Near-duplicates by exact Jaccard similarity of shingle sets, with fingerprints to find the candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm import common, simhash, words


BANDS, ROWS = 40, 6
#: Odd factors; the least product of a set's hashes with each is one of its min-hashes.
_FACTORS = words.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def band_keys(members: np.ndarray) -> np.ndarray:
    """One key a band of ROWS min-hashes. Sets of Jaccard similarity J share one with 1 - (1 - J^6)^40: 0.999995 at 0.8."""
    low = np.full(len(_FACTORS), np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(members), 512):
        low = np.minimum(low, (members[at : at + 512, None] * _FACTORS).min(axis=0))
    key = np.arange(BANDS, dtype=np.uint64)
    for part in low.reshape(BANDS, ROWS).T:
        key = words.mix(key ^ part) + words.MIX_A
    return key


def _sketches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, buf, offsets in words.text_blocks(batch, "body"):
            whole, rows = buf.tobytes(), []
            for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                hashes = simhash.shingle_hashes(whole[i:j], shingle)
                members = np.unique(hashes)
                rows.append((xxhash.xxh64_intdigest(members.tobytes()), simhash.majority(hashes), len(members), band_keys(members).tobytes()))
            *numbers, bands = zip(*rows)
            node, fp, size = (np.array(x, dtype=np.uint64).view(np.int64) for x in numbers)
            cols = [batch.column(c).slice(a, b - a) for c in ("doc", "digest")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(node), pa.array(fp), pa.array(size), pa.array(bands, pa.binary())], ["doc", "digest", "node", "fp", "size", "bands"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per node a row for each band key."""
    for batch in batches:
        if batch.num_rows:
            keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(batch.column("node").to_numpy(), BANDS))], ["key", "node"])


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, buf, offsets in words.text_blocks(batch, "body"):
            whole = buf.tobytes()
            made = [np.unique(simhash.shingle_hashes(whole[i:j], shingle)).tobytes() for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            cols = [batch.column(c).slice(a, b - a) for c in ("node", "component", "block", "blocks")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(made, pa.binary())], ["node", "component", "block", "blocks", "members"])


def alike(sets: list[np.ndarray], similarity: float, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j), i of left and j of right, whose sets (sorted, without repeats) have that Jaccard similarity or more."""
    size = np.array([len(s) for s in sets])
    value, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    count = np.bincount(at, minlength=len(value))
    start = np.cumsum(count) - count
    posting = owner[np.argsort(at, kind="stable")]
    first = np.cumsum(size) - size
    a, b = [], []
    for i in left.tolist():
        mine = at[first[i] : first[i] + size[i]]
        mine = mine[count[mine] > 1]
        n = count[mine]
        where = np.repeat(start[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(posting[where], minlength=len(sets))[right]
        near = right[(both >= similarity * (size[i] + size[right] - both) - 1e-9) & (both > 0) & (right != i)]
        a.append(np.full(len(near), i))
        b.append(near)
    return np.concatenate(a), np.concatenate(b)


def _links(node: np.ndarray, side: np.ndarray, sets: list[np.ndarray], similarity: float) -> pa.RecordBatch | None:
    """Links of one pair of blocks (sides 0 and 1), or of one block with itself (side 0 alone), as a forest."""
    if len(sets) < 2:
        return None
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    a, b = alike(sets, similarity, left, right if len(right) else left)
    if not len(a):
        return None
    a, b = simhash._forest(node[a].view(np.uint64), node[b].view(np.uint64))
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def _verify(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by component, p and q; each such group is two blocks of a candidate component, or one."""
    held, node, side, sets = None, [], [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        group = list(zip(*(batch.column(c).to_pylist() for c in ("component", "p", "q"))))
        nodes, sides, members = (batch.column(c) for c in ("node", "side", "members"))
        for k, key in enumerate(group):
            if key != held:
                if (found := _links(np.array(node, np.int64), np.array(side), sets, similarity)) is not None:
                    yield found
                held, node, side, sets = key, [], [], []
            node.append(nodes[k].as_py())
            side.append(sides[k].as_py())
            sets.append(np.frombuffer(members[k].as_py(), np.uint64))
    if (found := _links(np.array(node, np.int64), np.array(side), sets, similarity)) is not None:
        yield found


def _candidates(nodes: DataFrame, limit: int) -> DataFrame:
    """Edges (a, b) that connect nodes with fingerprints at most `limit` bits apart, and nodes that share a band key."""
    firsts = common.land(nodes.groupBy("fp").agg(F.min("node").alias("first")), "similar-prints")
    same = nodes.join(firsts, "fp").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    end = lambda c: firsts.select(F.col("fp").alias(c), F.col("first").alias(f"node_{c}"))
    close = simhash.hamming_forest(firsts, limit).distinct().join(end("a"), "a").join(end("b"), "b")
    keyed = nodes.select("node", "bands").mapInArrow(_keyed, "key long, node long")
    shared = keyed.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last").drop("last")
    banded = keyed.join(shared, "key").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()
    return same.unionByName(close.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))).unionByName(banded)


def similar_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, limit: int = 7, block_rows: int = 256, block_shingles: int = 1 << 20
) -> DataFrame:
    """Per row: doc, digest (common.digest of the text), node (its shingle set) and root, the group's smallest node.

    Sketches only say which documents are compared: SimHash and min-hash bands give candidate components, and inside one every two shingle sets are
    compared in full. A link is a Jaccard similarity of at least `similarity`, and groups are what links connect. Equal sets are one
    node. A component of more than block_rows sets (or block_shingles shingles) is dealt in blocks, each two of which
    meet in a group of rows of its own, so no task holds more than two blocks at a time.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc"), common.digest(F.col(text_col)).alias("digest"), F.col(text_col).alias("body"))
    made = d.mapInArrow(lambda it: _sketches(it, shingle), "doc long, digest long, node long, fp long, size long, bands binary")
    made = common.land(made, "similar")
    nodes = common.land(made.groupBy("node").agg(F.min("fp").alias("fp"), F.min("digest").alias("digest"), F.max("size").alias("size"), F.min("bands").alias("bands")), "similar-nodes")
    groups = common.components(_candidates(nodes, limit))
    placed = common.land(nodes.join(groups, "node").select("node", "digest", "size", "component"), "similar-candidates")
    counts = placed.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("n") / block_rows), F.ceil(F.col("shingles") / block_shingles)).cast("int")
    placed = placed.join(counts.select("component", blocks.alias("blocks")), "component")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    one = d.select("digest", "body").join(placed.select("digest", "node", "component", "block", "blocks"), "digest").dropDuplicates(["node"])
    sets = one.mapInArrow(lambda it: _sets(it, shingle), "node long, component long, block int, blocks int, members binary")
    met = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("component", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), (F.col("block") > F.col("other")).cast("byte").alias("side"), "node", "members")
    dealt = met.repartition(common.shuffle_partitions(docs.sparkSession), "component", "p", "q").sortWithinPartitions("component", "p", "q", "side")
    roots = common.components(dealt.mapInArrow(lambda it: _verify(it, similarity), "a long, b long"))
    return made.join(roots, "node", "left").select("doc", "digest", "node", F.coalesce("component", "node").alias("root"))
