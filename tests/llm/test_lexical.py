"""Ranked search against a plain version, and the bounds of the tries."""

import math
import random

import numpy as np
import pytest

from panelspark.llm import lexical, queries, words

SCHEMA = "doc_id long, text string, digest string, score int, rank string, n int, `a.b` int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    out, word = [], ""
    for c in (text or "").translate(LOWER) + " ":
        if (c.isascii() and c.isalnum()) or ord(c) > 127:
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def plain(docs, items, k=10):
    """Per item the scores by rank with the ids that may stand there."""
    words_of = [(d, split(t)) for d, t in docs]
    held = [(d, w) for d, w in words_of if w]
    n, total = len(held), sum(len(w) for _, w in held)
    df = {}
    for _, w in held:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for i, text in items:
        scored = []
        for d, w in held:
            m, score = 10 + (90 * len(w) * n) // total, 0
            for t in set(split(text)):
                tf = w.count(t)
                if tf:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            if score:
                scored.append((-score, d is None, d or 0))
        out += [(i, r + 1, None if last else d, -s) for r, (s, last, d) in enumerate(sorted(scored)[:k])]
    return out


def corpus(n=400):
    rng = random.Random(8)
    common_words, rare = [f"c{k}" for k in range(12)], [f"r{k}é" for k in range(300)] + [f"a-very-long-term-beyond-eight-bytes{k}".replace("-", "") for k in range(40)]
    make = lambda: " ".join(rng.choice(common_words) if rng.random() < 0.7 else rng.choice(rare) for _ in range(rng.randrange(1, 90)))
    texts = [make() for _ in range(n)]
    texts += [texts[3]] * 40 + [texts[4] + " C1, R5É r5é", "", None, " \n.,;", "é", "R1É." * 3000, make() + texts[7].upper()]
    rows = [(k * 13 % 997, t) for k, t in enumerate(texts)]
    rows += [(None, texts[3]), (None, texts[5]), (rows[0][0], texts[9]), rows[1], rows[1]]
    items = [(k, " ".join(rng.sample(texts[k % 50].split() or ["x"], min(6, len(texts[k % 50].split())))) + f" C{k % 12}") for k in range(40)]
    items += [(50, None), (51, ""), (52, "no such term"), (53, texts[3]), (54, " ".join(rare)), (None, "c1 r2é"), (55, "c1"), (56, "r7é r7é R8É")]
    return rows, items


@pytest.fixture(scope="module")
def frames(spark):
    rows, items = corpus()
    docs = spark.createDataFrame([(d, t, "x", 1, "r", 2, 3) for d, t in rows], SCHEMA).repartition(3)
    return docs, spark.createDataFrame([(i, t, "x", 1, "r", 2, 3) for i, t in items], SCHEMA.replace("doc_id", "item_id"))


def key(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("options", [{}, {"leaf": 1, "cells": 1, "most_terms": 5}, {"leaf": 4, "cells": 9000, "block_bytes": 900, "k": 3}])
def test_ranked_documents(frames, options):
    docs, items = frames
    got = lexical.ranked_documents(docs, items, **options)
    assert got.columns == ["item_id", "rank", "doc", "score"]
    assert key(got.collect()) == key(plain(*corpus(), k=options.get("k", 10)))


def test_no_documents_and_no_items(frames):
    docs, items = frames
    assert lexical.ranked_documents(docs.limit(0), items).count() == 0
    assert lexical.ranked_documents(docs.where("text = ''"), items).count() == 0
    assert lexical.ranked_documents(docs, items.limit(0)).count() == 0


def test_repeated_items_count_once_and_shared_ids_apart(spark, frames):
    docs, _ = frames
    items = spark.createDataFrame([(1, "c1 r2é"), (1, "c1 r2é"), (1, "c2 r3é")], "item_id long, text string")
    got = lexical.ranked_documents(docs, items, k=2).collect()
    assert sorted((r.item_id, r.rank) for r in got) == [(1, 1), (1, 1), (1, 2), (1, 2)]


def shard(seed, docs, width):
    rng = np.random.default_rng(seed)
    held = [np.sort(rng.choice(width, min(width, 1 + rng.poisson(6)), replace=False, p=(p := 1 / np.arange(1, width + 1)) / p.sum())) for _ in range(docs)]
    row = np.repeat(np.arange(docs), [len(h) for h in held])
    return row, np.concatenate(held), rng.integers(1, 9, len(row)), rng.integers(10, 400, docs)


@pytest.mark.parametrize("leaf", [1, 4, 32])
def test_nodes_bound_their_documents(leaf):
    row, term, tf, m = shard(leaf, 300, 60)
    tree = lexical.Tree(row, term, tf, m, 60, leaf, depth=5)
    dense = np.zeros((60, 300), np.int64)
    dense[term, row] = lexical.saturation(tf, m[row])
    assert (tree.documents == dense[:, tree.order]).all()
    for a, b, kids, bound in zip(tree.low, tree.high, tree.kids, tree.nodes.T):
        assert (tree.documents[:, a:b].max(axis=1) <= bound).all()
        if kids:
            assert sorted((tree.low[x], tree.high[x]) for x in kids) == [(tree.low[x], tree.high[x]) for x in kids]
            assert tree.low[kids[0]] == a and tree.high[kids[-1]] == b
            assert all(tree.high[x] == tree.low[y] for x, y in zip(kids, kids[1:]))
        elif leaf < 32:
            assert b - a <= leaf or b - a < 60  # only documents with one path in common


def test_subtrees_below_the_bound_are_not_scored():
    row, term, tf, m = shard(7, 3000, 200)
    tree = lexical.Tree(row, term, tf, m, 200, 8)
    best = lexical._Best(10)
    asked, weights = np.array([0, 3, 60, 150]), np.array([10.0, 400, 3000, 5000])
    scored = tree.search(asked, weights, lambda d, s: best.add([(-int(x), False, int(y), 0) for x, y in zip(s, d)]), best.least)
    dense = np.zeros((200, 3000))
    dense[term, row] = lexical.saturation(tf, m[row])
    want = sorted((-int(s), False, j, 0) for j, s in enumerate(weights @ dense[asked]))[:10]
    assert best.rows == want
    assert scored < 1500


def test_words_of_one_hash_are_told_apart_by_bytes(monkeypatch):
    monkeypatch.setattr(lexical, "word_hashes", lambda buf, starts, ends: (ends - starts).astype(np.uint64))
    known = lexical.Vocabulary(["abc", "averylongterm", "x"])
    text = b"abc abd x y averylongterm averylongtern"
    buf = np.frombuffer(text, np.uint8)
    starts, ends, _ = words.spans(buf, np.array([0, len(text)]))
    at, term = known.find(buf, starts, ends)
    assert at.tolist() == [0, 2, 4] and term.tolist() == [0, 2, 1]


def test_registered_query(spark, frames, tmp_path):
    docs, items = frames
    docs.drop("a.b").write.parquet(f"{tmp_path}/documents.parquet")
    items.drop("a.b").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.QUERIES["op13_ranked_search"](spark, str(tmp_path))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert key(got.collect()) == key(plain(*corpus()))
