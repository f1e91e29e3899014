"""Plain versions of the contracts, on lists of (doc_id, text, ...) rows; small inputs only."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import xxhash


def later(doc):
    return float("inf") if doc is None else doc


def spaces(text):
    return (text or "").encode().split()


def simhash(text, n=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(items, linked):
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(items))]


def repeated(rows, parts, join, window=50):
    """Per row: symbols, removed, spans, kept digest."""
    seqs = [(doc, parts(text)) for doc, text in rows]
    low = {}
    for doc, s in seqs:
        for i in range(len(s) - window + 1):
            key = tuple(s[i : i + window])
            low[key] = min(low.get(key, float("inf")), later(doc))
    out = []
    for doc, s in seqs:
        gone = np.zeros(len(s), bool)
        for i in range(len(s) - window + 1):
            if low[tuple(s[i : i + window])] < later(doc):
                gone[i : i + window] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((doc, len(s), int(gone.sum()), runs, hashlib.sha256(join([x for x, g in zip(s, gone) if not g])).hexdigest()))
    return out


def lines(rows, min_docs=10):
    strip = " \t\n\x0b\x0c\r"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keyed = [(doc, [(x, x.strip(strip).translate(low)) for x in (text or "").split("\n")]) for doc, text in rows]
    docs = {}
    for doc, ls in keyed:
        for _, k in ls:
            docs.setdefault(k, set()).add(doc)
    out = []
    for doc, ls in keyed:
        kept = [x for x, k in ls if not (k and len(docs[k]) >= min_docs)]
        out.append((doc, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def quality(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    ls = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = {}
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i : i + 3]), []).append(i)
    hit = {i + k for v in grams.values() if len(v) > 1 for i in v for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls)), len(hit)


def phrases(text, table):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(i, label) for p, label in table.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())
