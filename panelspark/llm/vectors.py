"""Embedding near-duplicates over robust-pruned graphs of overlapping cluster shards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm import common, graph
from panelspark.llm.simhash import _forest as forest


def _matrix(column) -> np.ndarray:
    """Rows of one length as a matrix of unit vectors in double precision."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distinct_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, others, nodes). rows: vec_id and two hashes of the vector for each usable row; others: the ids of the rest; nodes: one landed row
    per distinct vector with rep (a hash of it, so that vectors sharing an id are nodes of their own), low (its smallest id), copies and vec. A row is
    usable if it has an id and a vector that is not zero and whose components are all present and finite."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"))
    whole = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & (F.size("vec") > 0) & whole & F.exists("vec", lambda x: x != 0), F.lit(False))
    rows = v.where(usable).select("vec_id", "vec", F.xxhash64("vec").alias("h1"), F.hash("vec").alias("h2"))
    nodes = rows.groupBy("h1", "h2").agg(F.min_by("vec", "vec_id").alias("vec"), F.min("vec_id").alias("low"), F.count("*").alias("copies")).withColumn("rep", F.col("h1"))
    return rows.select("vec_id", "h1", "h2"), v.where(~usable).select("vec_id"), common.land(nodes, "vectors")


def _route(batches, pivots, overlap: int, probes: int):
    """Each vector to shards of its dimension's nearest pivots: role 0 in the nearest one's (it owns the vector), 1 in further ones for
    overlap, 2 as a query."""
    for batch in batches:
        dims = np.array([len(v) for v in batch.column("vec").to_pylist()])
        for dim in np.unique(dims).tolist():
            rows = batch.filter(pa.array(dims == dim))
            base, p = pivots.value[dim]
            x, k = _matrix(rows.column("vec")), min(max(overlap, probes), len(p))
            step = max(1, (1 << 22) // len(p))  # similarities to all pivots are held for so many rows at a time
            order = np.concatenate([_nearest(x[a : a + step] @ p.T, k) for a in range(0, len(x), step)]) + base
            for rank in range(order.shape[1]):
                for role in ([0] if rank == 0 else [1] if rank < overlap else []) + [2] * (rank < probes):
                    cols = [pa.array(order[:, rank]), pa.array(np.full(len(order), role, np.int8)), *(rows.column(c) for c in ("rep", "copies", "vec"))]
                    yield pa.RecordBatch.from_arrays(cols, ["shard", "role", "rep", "copies", "vec"])


def _nearest(near: np.ndarray, k: int) -> np.ndarray:
    """The k greatest of each row, best first, ties by position."""
    top = np.sort(np.argpartition(-near, k - 1, axis=1)[:, :k], axis=1)
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, axis=1), axis=1, kind="stable"), axis=1)


def _dealt(routed: DataFrame, cap: int) -> DataFrame:
    """Bound what one task holds: shards that own over cap vectors are cut into pieces by id and those with over 16 * cap queries into blocks.

    Queries go to every piece; members go to one piece, once for each block of queries.
    """
    sizes = routed.groupBy("shard").agg(F.count_if(F.col("role") == 0).alias("owned"), F.count_if(F.col("role") == 2).alias("asked"))
    sizes = common.land(sizes.select("shard", F.greatest(F.lit(1), F.ceil(F.col("owned") / cap)).alias("pieces"), F.greatest(F.lit(1), F.ceil(F.col("asked") / (16 * cap))).alias("blocks")), "shards")
    all_of = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    one_of = lambda n: F.array(F.pmod(F.xxhash64("rep"), F.col(n)))
    asks = F.col("role") == 2
    out = routed.join(sizes, "shard").withColumn("piece", F.explode(F.when(asks, all_of("pieces")).otherwise(one_of("pieces"))))
    out = out.withColumn("block", F.explode(F.when(asks, one_of("blocks")).otherwise(all_of("blocks"))))
    return common.land(out.select("shard", "piece", "block", "role", "rep", "copies", "vec"), "routed", by="role")


def _build(table: pa.Table) -> pa.Table:
    rep = table.column("rep").to_numpy()
    lists, _ = graph.build(_matrix(table.column("vec")))
    return pa.table({"rep": rep, "near": pa.array([rep[v] for v in lists], pa.list_(pa.int64()))})


def _search(members: pa.Table, queries: pa.Table, floor: float, beam: int) -> pa.Table:
    """Links of the queries to vectors the shard owns: counts with copies as rows (a, null, n), and a spanning forest as rows (a, b, 0)."""
    empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    if not members.num_rows or not queries.num_rows:
        return empty
    rep, copies, owned = (members.column(c).to_numpy() for c in ("rep", "copies", "role"))
    order = np.argsort(rep, kind="stable")
    members, rep, copies, owned = members.take(pa.array(order)), rep[order], copies[order], owned[order] == 0
    x, asked = _matrix(members.column("vec")), queries.column("rep").to_numpy()
    lists = []
    for near in members.column("near").to_pylist():
        at = np.searchsorted(rep, np.array(near or [], np.int64))
        lists.append(at[(at < len(rep)) & (rep[np.minimum(at, len(rep) - 1)] == np.array(near or [], np.int64))])
    own = np.searchsorted(rep, asked)
    own = np.where((own < len(rep)) & (rep[np.minimum(own, len(rep) - 1)] == asked), own, -1)
    medoid = int(np.argmax(x @ x.mean(axis=0)))
    q, n = graph.range_search(x, graph.padded(lists), medoid, _matrix(queries.column("vec")), own, floor, beam)
    keep = owned[n] & (asked[q] != rep[n])
    q, n = q[keep], n[keep]
    links = np.bincount(q, copies[n], len(asked)).astype(np.int64)
    some = np.flatnonzero(links)
    a, b = forest(asked[q].astype(np.uint64), rep[n].astype(np.uint64)) if len(q) else (np.zeros(0, np.uint64),) * 2
    return pa.table(
        {"a": np.concatenate([asked[some], a.astype(np.int64)]), "b": pa.array([None] * len(some) + b.astype(np.int64).tolist(), pa.int64()),
         "n": np.concatenate([links[some], np.zeros(len(a), np.int64)])}
    )


def _exact(batches, audited, floor: float):
    """True links of the audited vectors among the rows, by blocks: (rep, n)."""
    for batch in batches:
        dims = np.array([len(v) for v in batch.column("vec").to_pylist()])
        for dim, (ids, x) in audited.value.items():
            rows = batch.filter(pa.array(dims == dim))
            if rows.num_rows:
                rep, copies = rows.column("rep").to_numpy(), rows.column("copies").to_numpy()
                near = (_matrix(rows.column("vec")) @ x.T >= floor) & (rep[:, None] != ids[None, :])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(copies @ near)], ["rep", "n"])


def _by_dim(rows: list, vec) -> dict[int, list]:
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(len(r["vec"]), []).append(vec(r))
    return out


def _links(routed: DataFrame, floor: float, beam: int, cap: int) -> DataFrame:
    """Build per shard, join the lists of a node over its shards, search: landed rows (a, null, links) and (a, b, 0) of a forest."""
    routed, where = _dealt(routed, cap), ["shard", "piece", "block"]
    members = routed.where("role < 2")
    lists = members.where("block = 0").groupBy("shard", "piece").applyInArrow(lambda t: _build(t), "rep long, near array<long>")
    united = common.land(lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "adjacency")
    held = members.join(united, "rep").select(*where, "role", "rep", "copies", "vec", "near")
    asked = routed.where("role = 2").select(*(F.col(c).alias(c) for c in [*where, "rep", "vec"]))
    found = held.groupBy(*where).cogroup(asked.groupBy(*where))
    return common.land(found.applyInArrow(lambda a, b: _search(a, b, floor, beam), "a long, b long, n long"), "links")


def _components(links: DataFrame) -> DataFrame:
    return common.components(links.where("b is not null").select("a", "b"))


def near_duplicate_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", floor: float = 0.95, shard_rows: int = 1024, max_pivots: int = 65_536,
    overlap: int = 2, probes: int = 3, beam: int = 16, audit_rows: int = 512, recall: float = 0.95, tries: int = 3, least: float = 0.9,
) -> DataFrame:
    """Per row: vec_id, n_links, component (smallest id reachable), audit_recall.

    Equal vectors are one node with a count. Pivots, a hash-chosen sample of at most max_pivots nodes, cut the space into shards of about
    shard_rows; each node belongs to the shards of its `overlap` nearest pivots and asks those of its `probes` nearest. A robust-pruned graph is built
    per shard, the adjacency lists of a node are joined over its shards, and each query runs a range-expanding greedy search from the
    medoid. A second pass takes the components found as shards, so links between vectors of different first shards are counted too.
    Cosines are double precision, so no link is below the floor. Every node is indexed and asks. Links count once,
    since only the shard that owns a vector reports it, and leave a task as counts and a spanning forest, never as all pairs.

    Recall is audited on hash-chosen nodes against all rows by brute force; while it is below `recall`, beam and probes double, at most `tries`
    times; what stays below `least` raises and is not returned. Rows that share an id are vectors of their own, also if the vectors are equal. Rows with a null, zero or non-finite vector, or no id, have no links and are their own component; vectors of
    different dimension never link.
    """
    spark = vectors.sparkSession
    rows, alone, nodes = distinct_vectors(vectors, id_col, vec_col)
    n = nodes.count()
    chosen = nodes.orderBy(F.xxhash64("rep"), "rep").limit(min(max_pivots, -(-n // shard_rows))).select("vec").collect()
    grouped = _by_dim(chosen, lambda r: r["vec"])
    for r in nodes.select(F.size("vec").alias("d")).distinct().limit(max_pivots).collect():
        grouped.setdefault(r["d"], [np.eye(1, r["d"])[0].tolist()])
    pivots, base = {}, 0
    for d, found in sorted(grouped.items()):
        pivots[d] = (base, _matrix(pa.array(found, pa.list_(pa.float64()))))
        base += len(found)
    pivots = spark.sparkContext.broadcast(pivots)
    audit = nodes.orderBy(F.xxhash64("rep", F.lit(1)), "rep").limit(audit_rows).collect()
    audited = {d: (np.array([i for i, _ in v], np.int64), _matrix(pa.array([x for _, x in v], pa.list_(pa.float64())))) for d, v in _by_dim(audit, lambda r: (r["rep"], r["vec"])).items()}
    audited = spark.sparkContext.broadcast(audited)
    truth = nodes.select("rep", "copies", "vec").mapInArrow(lambda it: _exact(it, audited, floor), "rep long, n long")
    truth = common.land(truth.groupBy("rep").agg(F.sum("n").alias("n")), "audit")
    kind = nodes.schema["vec"].dataType.simpleString()
    cap = 4 * shard_rows
    for left in range(tries - 1, -1, -1):
        routed = nodes.select("rep", "copies", "vec").mapInArrow(lambda it, o=overlap, p=probes: _route(it, pivots, o, p), f"shard long, role byte, rep long, copies long, vec {kind}")
        groups = common.land(_components(_links(routed, floor, beam, cap)), "groups")
        shard = F.pmod(F.xxhash64("component"), F.lit(max(1, -(-groups.count() // shard_rows))))
        again = nodes.join(groups, F.col("rep") == F.col("node")).select(shard.alias("shard"), F.explode(F.array(F.lit(0).cast("byte"), F.lit(2).cast("byte"))).alias("role"), "rep", "copies", "vec")
        counts = _links(again, floor, beam, cap).where("b is null").groupBy("a").agg(F.sum("n").alias("met"))
        met = truth.join(counts, F.col("rep") == F.col("a"), "left")
        got = met.agg(F.sum("n").alias("n"), F.sum(F.least("n", F.coalesce("met", F.lit(0)))).alias("met")).first()
        reached = got["met"] / got["n"] if got["n"] else 1.0
        if reached >= recall or not left:
            break
        beam, probes = 2 * beam, 2 * probes
    if reached < least:
        raise RuntimeError(f"audited recall {reached:.3f} is below {least}: widen overlap, probes or beam")
    lows = groups.join(nodes.select("rep", "low"), F.col("node") == F.col("rep")).groupBy("component").agg(F.min("low").alias("smallest"))
    groups = groups.join(lows, "component").select("node", "smallest")
    named = nodes.select("h1", "h2", "rep", "low", "copies").join(counts, F.col("rep") == F.col("a"), "left").join(groups, F.col("rep") == F.col("node"), "left")
    named = named.select("h1", "h2", (F.coalesce("met", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("smallest", "low").alias("component"))
    linked = rows.join(named, ["h1", "h2"]).select("vec_id", "n_links", "component")
    alone = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component"))
    return linked.unionByName(alone).withColumn("audit_recall", F.lit(float(reached)))


def op3_embedding_near_dups(spark, sf_dir: str) -> DataFrame:
    found = near_duplicate_vectors(common.table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", F.col("component").alias("component_id"), (F.col("vec_id") == F.col("component")).alias("kept"), "audit_recall")
