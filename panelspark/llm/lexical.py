"""Ranked lexical search: branch-and-bound over tries of frequency-ordered document vectors."""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm import common
from panelspark.llm.words import eights, spans, text_blocks, word_hashes

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER_TEXT = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_BYTE = np.arange(256)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_LOWER = np.where(_UPPER, _BYTE + 32, _BYTE).astype(np.uint8)
_IS_TERM = ((_BYTE >= 48) & (_BYTE <= 57)) | _UPPER | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def terms_of(text: str | None) -> list[str]:
    return _TERM.findall((text or "").translate(_LOWER_TEXT))


class Vocabulary:
    """Terms by number. find() goes by hash and then compares all bytes, so two words are never taken for each other."""

    def __init__(self, terms: list[str]):
        raw = [t.encode() for t in terms]
        self.buf = np.frombuffer(b"".join(raw), np.uint8)
        self.ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
        self.starts = self.ends - np.array([len(r) for r in raw], np.int64)
        hashes = word_hashes(self.buf, self.starts, self.ends)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        if len(hashes) > 1 and (np.diff(self.hashes) == 0).any():
            raise ValueError("two query terms share a 64-bit hash")

    def __len__(self) -> int:
        return len(self.order)

    def find(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indexes of words that are terms, the terms' numbers)."""
        if not len(self) or not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = word_hashes(buf, starts, ends)
        slot = np.minimum(np.searchsorted(self.hashes, h), len(self) - 1)
        at = np.flatnonzero(self.hashes[slot] == h)
        term = self.order[slot[at]]
        size = ends[at] - starts[at]
        same = size == self.ends[term] - self.starts[term]
        here, there, k = eights(buf), eights(self.buf), 0
        while (more := np.flatnonzero(same & (size > k))).size:
            mask = _MASKS[np.minimum(size[more] - k, 8)]
            same[more] = (here[starts[at[more]] + k] & mask) == (there[self.starts[term[more]] + k] & mask)
            k += 8
        return at[same], term[same]


def _restrict(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    """Rows with a term -> number of terms, and those of the vocabulary with how often each occurs."""
    known = vocabulary.value
    for batch in batches:
        for a, b, raw, offsets in text_blocks(batch, "body"):
            buf = _LOWER[raw]
            starts, ends, first = spans(buf, offsets, _IS_TERM)
            n = np.diff(first)
            at, term = known.find(buf, starts, ends)
            doc = np.repeat(np.arange(b - a), n)[at]
            key, tf = np.unique(doc * max(len(known), 1) + term, return_counts=True)
            bounds = np.searchsorted(key, np.arange(b - a + 1) * max(len(known), 1)).astype(np.int64)
            ids, tf = (key % max(len(known), 1)).astype("<u4"), tf.astype("<u4")
            packed = [pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer((4 * bounds).tobytes()), pa.py_buffer(x.tobytes())]).cast(pa.binary()) for x in (ids, tf)]
            cols = [batch.column("doc").slice(a, b - a), batch.column("digest").slice(a, b - a), pa.array(n.astype(np.int64)), *packed]
            yield pa.RecordBatch.from_arrays(cols, ["doc", "digest", "n", "terms", "tfs"]).filter(pa.array(n > 0))


def _count_documents(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(size, np.int64)
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            total += np.bincount(np.frombuffer(b"".join(batch.column("terms").slice(a, 1024).to_pylist()), "<u4"), minlength=size)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "df"])


def saturation(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Grows with tf and falls with m, so a subtree's largest tf and smallest m bound all of its documents."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Tree:
    """A trie of documents whose terms stand in order of document frequency, most frequent first.

    Documents are sorted by their paths; a node is a range of them that shares a path, split where paths part for the first time.
    Neighbouring children are put together up to `leaf` documents, where the documents themselves are scored.
    Each node holds the saturation of the largest tf of every term below it with the smallest m below it.
    """

    def __init__(self, row: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray, width: int, leaf: int, depth: int = 64):
        docs = len(m)
        bounds = np.searchsorted(row, np.arange(docs + 1))
        level = np.arange(len(row)) - bounds[row]
        path = np.zeros((docs, depth), ">u4")
        near = level < depth
        path[row[near], level[near]] = term[near] + 1
        self.order = np.argsort(np.ascontiguousarray(path).view(f"S{4 * depth}").ravel(), kind="stable")
        path, place = path[self.order], np.empty(docs, np.int64)
        place[self.order] = np.arange(docs)
        parts = path[1:] != path[:-1]
        shared = np.where(parts.any(axis=1), parts.argmax(axis=1), depth)
        self.low, self.high, self.kids = [0], [docs], [[]]
        todo, leaves = [0], []
        while todo:
            node = todo.pop()
            a, b = self.low[node], self.high[node]
            inner = shared[a : b - 1]
            if b - a <= leaf or inner.min() == depth:
                leaves.append(node)
                continue
            cuts = [a, *(a + 1 + np.flatnonzero(inner == inner.min())).tolist(), b]
            start = a
            for x, y in zip(cuts[1:], [*cuts[2:], b + leaf + 1]):
                if y - start > leaf or x == b:
                    if (start, x) != (a, b):
                        self.kids[node].append(len(self.low))
                        todo.append(len(self.low))
                        self.low.append(start)
                        self.high.append(x)
                        self.kids.append([])
                    start = x
            if not self.kids[node]:
                leaves.append(node)
        sat, m = saturation(tf, m[row]), m[self.order]
        self.documents = np.zeros((width, docs), np.int32)
        self.documents[term, place[row]] = sat
        tfs = np.zeros((width, docs), np.int32)
        tfs[term, place[row]] = tf
        nodes = len(self.low)
        most, least = np.zeros((width, nodes), np.int32), np.zeros(nodes, np.int64)
        leaves = np.array(sorted(leaves, key=self.low.__getitem__))
        edges = np.array(self.low)[leaves]
        most[:, leaves], least[leaves] = np.maximum.reduceat(tfs, edges, axis=1), np.minimum.reduceat(m, edges)
        for node in range(nodes - 1, -1, -1):  # children come after their parents
            if self.kids[node]:
                most[:, node], least[node] = most[:, self.kids[node]].max(axis=1), least[self.kids[node]].min()
        t, node = np.nonzero(most)
        self.nodes = np.zeros((width, nodes), np.int32)
        self.nodes[t, node] = saturation(most[t, node].astype(np.int64), least[node])

    def search(self, terms: np.ndarray, weights: np.ndarray, take, least: int) -> int:
        """Depth first, most promising child first. take(documents, scores) gets those that may rank and tells the score that is needed from then on.

        Returns the number of documents scored.
        """
        stack, scored = [(float(weights @ self.nodes[terms, 0]), 0)], 0
        while stack:
            bound, node = stack.pop()
            if bound < least:
                continue
            if kids := self.kids[node]:
                bounds = weights @ self.nodes[np.ix_(terms, kids)]
                for j in np.argsort(bounds).tolist():
                    if bounds[j] >= least:
                        stack.append((bounds[j], kids[j]))
                continue
            a, b = self.low[node], self.high[node]
            scores = weights @ self.documents[terms, a:b]
            scored += b - a
            good = np.flatnonzero(scores >= least)
            if len(good):
                least = take(self.order[a + good], scores[good])
        return scored


class _Best:
    """The k best of one item: by score, then id (missing last), then digest."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def least(self) -> int:
        return max(1, -self.rows[-1][0]) if len(self.rows) == self.k else 1

    def add(self, rows: list) -> int:
        self.rows = sorted(self.rows + rows)[: self.k]
        return self.least


def item_groups(items: list[np.ndarray], most_terms: int) -> list[tuple[np.ndarray, list[int]]]:
    """Items in a row with at most most_terms different terms together, or one item with more: (terms, items)."""
    out, terms, held = [], set(), []
    for k, item in enumerate(items):
        wider = terms | set(item.tolist())
        if held and len(wider) > most_terms:
            out.append((np.array(sorted(terms), np.int64), held))
            wider, held = set(item.tolist()), []
        terms, held = wider, [*held, k]
    return [*out, (np.array(sorted(terms), np.int64), held)] if held else out


def _search(batches: Iterator[pa.RecordBatch], query, k: int, leaf: int, cells: int, most_terms: int) -> Iterator[pa.RecordBatch]:
    """The k best documents of a task for every item. Documents are put into tries as many as `cells` allows, equal vectors once."""
    ids, items, weight, df, n_docs, n_terms = query.value
    best = [_Best(k) for _ in items]
    groups = item_groups(items, most_terms)
    shard = max(64, cells // max([len(t) for t, _ in groups], default=1))

    def rank(held: dict) -> None:
        vectors = list(held)
        who = list(held.values())
        m = 10 + (90 * np.array([n for n, _, _ in vectors], np.int64) * n_docs) // n_terms
        terms = np.frombuffer(b"".join(t for _, t, _ in vectors), "<u4").astype(np.int64)
        tf = np.frombuffer(b"".join(f for _, _, f in vectors), "<u4").astype(np.int64)
        row = np.repeat(np.arange(len(vectors)), [len(t) // 4 for _, t, _ in vectors])
        for wanted, members in groups:
            by_df = wanted[np.argsort(-df[wanted], kind="stable")]
            local = np.full(len(df), -1, np.int64)
            local[by_df] = np.arange(len(by_df))
            t = local[terms]
            at = np.flatnonzero(t >= 0)
            at = at[np.lexsort((t[at], row[at]))]
            there, r = np.unique(row[at], return_inverse=True)
            if not len(there):
                continue
            tree = Tree(r, t[at], tf[at], m[there], len(by_df), leaf)
            for j in members:
                if len(items[j]):
                    take = lambda docs, scores, j=j: best[j].add([(-int(s), *d) for x, s in zip(there[docs].tolist(), scores.tolist()) for d in who[x]])
                    tree.search(local[items[j]], weight[items[j]], take, best[j].least)

    held: dict = {}
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            for r in batch.slice(a, 1024).to_pylist():
                if r["terms"]:
                    same = held.setdefault((r["n"], r["terms"], r["tfs"]), [])
                    same.append((r["doc"] is None, r["doc"] or 0, r["digest"]))
                    if len(same) > 2 * k:  # of documents that score alike for every item, the first k by id are enough
                        same[:] = sorted(same)[:k]
                    if len(held) >= shard:
                        rank(held)
                        held = {}
    if held:
        rank(held)
    rows = [(j, ids[j], None if last else doc, digest, -score) for j, b in enumerate(best) for score, last, doc, digest in b.rows]
    schema = pa.schema([("item", pa.int32()), ("item_id", pa.int64()), ("doc", pa.int64()), ("digest", pa.int64()), ("score", pa.int64())])
    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)


def ranked_documents(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text",
    block_bytes: int = 4 << 20, most_terms: int = 4096, leaf: int = 32, cells: int = 8 << 20,
) -> DataFrame:
    """The k best documents of each item with a score above 0: (item_id, rank, doc, score).

    Items are taken in blocks of about block_bytes of text, the longest item above that: a block's vocabulary is what a broadcast holds. Documents
    are read once a block and land as vectors of the block's terms. Document frequencies, the number of documents with a term and
    of all terms count every document. Tasks build tries over their vectors for items of at most most_terms terms together
    (`cells` numbers a trie) and search each item depth first; what bounds below the item's k-th score of the task is not looked at,
    which loses nothing. Tasks' lists are cut to k in two steps, so no group holds more than a share of all tasks.

    Ties go by id, missing ids last, then by a hash of the text. Every row is a document of its own, also
    with a repeated or missing id, and every row of items is an item of its own; repeated rows of items that are equal count
    once. Missing texts have no terms; items without a term, or whose terms no document holds, have no rows.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(query_col), F.lit("")).alias("body")).distinct()
    size = asked.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    d = docs.select(F.col(id_col).cast("long").alias("doc"), common.digest(F.col(text_col)).alias("digest"), F.col(text_col).alias("body"))
    out = None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("item_id", "body"), F.lit(blocks)) == block).orderBy("item_id", "body").collect()
        ranked = _ranked_block(d, [(r["item_id"], sorted(set(terms_of(r["body"])))) for r in part], k, most_terms, leaf, cells).withColumn("block", F.lit(block))
        out = ranked if out is None else out.unionByName(ranked)
    n = common.shuffle_partitions(spark)
    order = [F.desc("score"), F.asc_nulls_last("doc"), "digest"]
    some = Window.partitionBy("block", "item", F.pmod(F.xxhash64("doc", "digest"), F.lit(n))).orderBy(*order)
    every = Window.partitionBy("block", "item").orderBy(*order)
    first = out.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
    return first.withColumn("rank", F.row_number().over(every)).where(F.col("rank") <= k).select("item_id", "rank", "doc", "score")


def _ranked_block(d: DataFrame, items: list[tuple[int, list[str]]], k: int, most_terms: int, leaf: int, cells: int) -> DataFrame:
    spark = d.sparkSession
    terms = sorted({t for _, ts in items for t in ts})
    number = {t: j for j, t in enumerate(terms)}
    vocabulary = spark.sparkContext.broadcast(Vocabulary(terms))
    vectors = d.mapInArrow(lambda it: _restrict(it, vocabulary), "doc long, digest long, n long, terms binary, tfs binary")
    vectors = common.land(vectors, "vectors")
    n_docs, n_terms = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(terms), np.int64)
    counted = vectors.select("terms").mapInArrow(lambda it, size=len(terms): _count_documents(it, size), "term long, df long")
    for r in counted.groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row per term of the block
        df[r["term"]] = r["df"]
    weight = np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1)))
    asked = [np.array([number[t] for t in ts], np.int64) for _, ts in items]
    query = spark.sparkContext.broadcast(([i for i, _ in items], asked, weight, df, n_docs, n_terms))
    made = vectors.mapInArrow(
        lambda it: _search(it, query, k, leaf, cells, most_terms), "item int, item_id long, doc long, digest long, score long"
    )
    return made


def op13_ranked_search(spark, sf_dir: str) -> DataFrame:
    ranked = ranked_documents(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"), k=10)
    return ranked.select("item_id", "rank", F.col("doc").alias("doc_id"), "score")


OP13_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), tf AS (
  SELECT doc_id, term, count(*)::BIGINT AS tf FROM words GROUP BY ALL
), sizes AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id
), corpus AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sizes
), lengths AS (
  SELECT doc_id, 10 + (90 * n * docs) // terms AS m FROM sizes, corpus
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, corpus GROUP BY term, docs
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN lengths USING (doc_id) GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
"""
