"""Corpus operators against plain versions, on texts with nulls, repeats, ties and clashing columns."""

from __future__ import annotations

import random

import numpy as np
import plain
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from panelspark.llm import bwt, fmindex, graph, licenses, lines, mixing, packing, quality, rans, segments, simhash, tokens, vectors, words

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, source string, part long, body string, doc string, h1 int, uid string, n int"


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus():
    rng = random.Random(5)
    shared = sentence(rng, 70)
    base = [sentence(rng, rng.randrange(1, 160)) for _ in range(30)]
    texts = base + [base[3], base[3], base[4] + " tail", "head " + base[5]]
    texts += [sentence(rng, 20) + " " + shared + " " + sentence(rng, rng.randrange(0, 20)) for _ in range(14)]
    near = sentence(rng, 300)
    texts += [near.replace("w1 ", f"x{k} ", 1) for k in range(6)]
    texts += ["Same line\nown " + str(k) + "\n  SAME LINE \t\n" for k in range(12)]
    texts += ["", None, " \n\t ", "é", "É\x1cÄ one", "All rights reserved. CC-BY cc by", "a " * 500, sentence(rng, 6000)]
    texts += ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License"]
    rows = [(k * 7 % 101, t, [None, "b", "a", "ä"][k % 4 if k % 5 else 1]) for k, t in enumerate(texts)]
    rows += [(None, base[3], "b"), (rows[0][0], base[0], "a"), (rows[1][0], base[2], None), rows[2], rows[2]]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, s, 1, "x", "y", 2, "z", 3) for d, t, s in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def same(got, expected):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, expected), key=key)


def test_word_spans_and_hashes_follow_the_bytes():
    texts = ["a bb  ccc", "", "bb", " long-word-over-sixteen-bytes é", "a"]
    raw = [t.encode() for t in texts]
    buf, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])
    starts, ends, first = words.spans(buf, offsets)
    whole = b"".join(raw)
    assert [whole[a:b] for a, b in zip(starts, ends)] == [w for r in raw for w in r.split()]
    assert np.diff(first).tolist() == [len(r.split()) for r in raw]
    h = words.word_hashes(buf, starts, ends)
    assert h[1] == h[3] and h[0] == h[-1] and len(set(h.tolist())) == 5


def test_equal_windows_have_equal_segment_keys():
    rng = np.random.default_rng(2)
    part = rng.integers(1, 1 << 60, 80).astype(np.uint64)
    symbols = np.concatenate([rng.integers(1, 1 << 60, 40).astype(np.uint64), part, rng.integers(1, 1 << 60, 33).astype(np.uint64), part])
    bounds = np.array([0, 60 + 53, len(symbols)])
    key, start, count, _ = segments.segments(symbols, bounds, 50, 8)
    of = {s + i: k for k, s, n in zip(key.tolist(), start.tolist(), count.tolist()) for i in range(n)}
    second = 40 + 80 + 33
    for i in range(31):
        if 40 + i + 50 <= bounds[1] and second + i >= bounds[1]:
            assert of[40 + i] == of[second + i]


def test_simhash(docs, none, rows):
    got = simhash.near_duplicates(docs).collect()
    fps = [plain.simhash(t) for _, t, _ in rows]
    where = plain.groups(fps, lambda a, b: bin(a ^ b).count("1") <= 3)
    low = {}
    for (d, _, _), g in zip(rows, where):
        low[g] = min((x for x in (low.get(g), d) if x is not None), default=None)
    same([(r.doc, r.fp & (1 << 64) - 1, r.component) for r in got], [(d, fp, low[g]) for (d, _, _), fp, g in zip(rows, fps, where)])
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize(("limit", "part_rows"), [(3, 4096), (3, 2), (7, 4096), (7, 3)])
def test_pigeonring_finds_every_link(spark, limit, part_rows):
    rng = random.Random(limit)
    values = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        values |= {x} | {x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, limit + 3))) for _ in range(4)}
    values = sorted(values)
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    edges = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash.hamming_forest(fps, limit, part_rows).collect()]
    assert all(bin(a ^ b).count("1") <= 64 for a, b in edges)
    want = plain.groups(values, lambda a, b: bin(a ^ b).count("1") <= limit)
    known = set(edges) | {(b, a) for a, b in edges}
    assert plain.groups(values, lambda a, b: (a, b) in known) == want


def test_chain_condition_keeps_every_close_pair():
    rng = np.random.default_rng(1)
    for limit, boxes in ((3, 4), (7, 8)):
        diff = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, limit + 1), replace=False)) for _ in range(500)], np.uint64)
        assert np.any([simhash.chain_holds(diff, ring, boxes, limit) for ring in range(boxes)], axis=0).all()


@pytest.mark.parametrize("options", [{}, {"hot_contents": 1, "chunk_bytes": 3000, "most_bits": 8}])
@pytest.mark.parametrize("unit", ["words", "bytes"])
def test_repeated_windows(docs, none, rows, unit, options):
    find, parts, join = {
        "words": (fmindex.repeated_passages, plain.spaces, b" ".join), "bytes": (bwt.repeated_substrings, lambda t: (t or "").encode(), bytes),
    }[unit]
    out = find(docs, **options).select("doc", "n_symbols", "n_removed", F.size("spans"), F.sha2("kept", 256))
    want = plain.repeated([(d, t) for d, t, _ in rows], parts, join)
    assert sum(r[2] for r in want) > 500
    same(out.collect(), want)
    assert find(none, **options).count() == 0


@pytest.mark.parametrize("resolve", [fmindex.resolve_words, bwt.resolve_bytes])
def test_resolvers_against_all_windows(resolve):
    rng = random.Random(9)
    for trial in range(40):
        window, letters = rng.choice([4, 5, 12, 50]), rng.choice([2, 3, 90])
        base = [rng.randrange(letters) for _ in range(260)]
        seqs = []
        for _ in range(rng.randrange(1, 12)):
            a = rng.randrange(0, 160)
            s = base[a : a + rng.randrange(window, window + 40)]
            if rng.random() < 0.6:
                s[rng.randrange(len(s))] = rng.randrange(letters)
            seqs.append([s[0]] * (window + 9) if rng.random() < 0.2 else s)
        docs = np.array([rng.randrange(5) for _ in seqs])
        low = {}
        for s, d in zip(seqs, docs):
            for i in range(len(s) - window + 1):
                low[tuple(s[i : i + window])] = min(low.get(tuple(s[i : i + window]), 99), d)
        want = {(j, i) for j, (s, d) in enumerate(zip(seqs, docs)) for i in range(len(s) - window + 1) if low[tuple(s[i : i + window])] < d}
        texts = [b" ".join(b"w%d" % x for x in s) if resolve is fmindex.resolve_words else bytes(s) for s in seqs]
        assert {(int(t), i) for t, a, b in zip(*resolve(texts, docs, window)) for i in range(a, b)} == want


def test_backward_search_over_texts_the_index_lacks():
    held = np.array([1, 2, 3, 4, 5, 6, 7, 8], np.int64)
    index = fmindex.FMIndex(held, np.array([8]), np.array([3]), 4)
    asked = np.array([9, 2, 3, 4, 5, 6, -1, 5, 6, 7, 8], np.int64)
    text, place, low = index.matches(np.maximum(asked, -1) * (asked < 9) - (asked == 9), np.array([0]), np.array([len(asked)]))
    assert sorted(place.tolist()) == [1, 2, 7] and set(low.tolist()) == {3}


def test_merged_transforms_give_common_prefixes():
    texts = [b"banana", b"bandana", b"ananas"]
    parts = []
    for t in texts:
        symbols, lengths, *_ = bwt.strided([t], 1)
        known = {c: i + 1 for i, c in enumerate(sorted(set(b"".join(texts))))}
        parts.append(bwt.Shard(np.array([known[c] for c in t]), lengths, 4, np.uint16).bwt)
        assert len(symbols) == len(t)
    merged, lcp = bwt.merge(parts, 4)
    rotations = sorted((t + b"\0")[i:] + (t + b"\0")[:i] for t in texts for i in range(len(t) + 1))
    prefix = [0] + [next((k for k in range(4) if a[k] != b[k]), 4) for a, b in zip([r[:4] for r in rotations], [r[:4] for r in rotations[1:]])]
    assert lcp.tolist() == prefix and np.bincount(merged).tolist() == [len(t) + 1 for t in texts]


def test_licenses(docs, none, rows):
    got = licenses.license_spans(docs).collect()
    base = lambda r: [s for s in r.base]
    out = [(r.doc, r.n_words, len(base(r)), min((s.start for s in base(r)), default=None), max((s.start for s in base(r)), default=None), ",".join(sorted({s.label for s in base(r)}))) for r in got]
    same(out, [(d, *plain.phrases(t, licenses.BASE_PHRASES)) for d, t, _ in rows])
    assert {s.label for r in got for s in r.templates} == {"apache-2.0", "mit"}
    assert all(0 <= r.score <= 1 for r in got) and licenses.license_spans(none).count() == 0


def test_templates_accept_exact_mandatory_wording_only():
    run = lambda markup, text: licenses.compile_template(markup).longest(licenses.fold(text.encode()).split(), 0)
    markup = "made by {{3}} under [[ the ]] rules [[ of this place ]]"
    assert run(markup, "Made by A B C under rules") == 7
    assert run(markup, "made by a under the rules of this place and more") == 9
    assert run(markup, "made by under rules") == -1
    assert run(markup, "made by a b c d under rules") == -1
    assert run(markup, "made by a under rules of this") == 5
    for label, text in licenses.TEMPLATES.items():
        assert licenses.opening(text), label


def test_lines(docs, none, rows):
    cut = lines.apply_bitmaps(docs, lines.repeated_line_bitmaps(docs))
    assert cut.columns[: len(docs.columns) - 1] == [c for c in docs.columns if c != "text"]
    want = plain.lines([(d, t) for d, t, _ in rows])
    assert sum(r[2] for r in want) == 24
    same(cut.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect(), want)
    empty = lines.apply_bitmaps(none, lines.repeated_line_bitmaps(none))
    assert empty.count() == 0


def test_first_occurrence_of_a_line_stays(spark):
    d = spark.createDataFrame([(k, "x\n" * (k % 70) + "common\n" + "y" * k) for k in range(12)], "doc_id long, text string")
    cut = lines.apply_bitmaps(d, lines.repeated_line_bitmaps(d, min_docs=10, keep_first=True)).orderBy("doc_id").collect()
    assert sum(r.text.split("\n").count("common") for r in cut) == 1 and "common" in cut[0].text
    assert sum(r.text.split("\n").count("x") for r in cut) == 1


def test_range_coding_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 1023, 1024, 1025, 70_000, 140_001):
        ids = np.minimum(rng.zipf(1.3, n), 49_000).astype(np.uint32)
        table = rans.Table(rans.scaled(np.bincount(ids, minlength=49_001)))
        block = rans.encode_block(ids, np.array([n]), table)
        out, lengths = rans.decode_block(block, table)
        assert np.array_equal(out, ids) and lengths.tolist() == [n]
        for k in range(-(-n // (rans.LANES * rans.CHECK_STEPS))):
            assert np.array_equal(rans.decode_block(block, table, k)[0], ids[k * 65_536 : (k + 1) * 65_536])
    broken = bytearray(block)
    broken[len(broken) // 2] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        rans.decode_block(bytes(broken), table)
    other = rans.Table(rans.scaled(np.ones(9, np.int64)))
    with pytest.raises(ValueError, match="table"):
        rans.decode_block(block, other)


@pytest.mark.parametrize(("name", "spaced"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_piecewise_ids_equal_whole_texts(rows, name, spaced):
    e = tokens.Encoder(public.path(name), spaced, 4, most=50)
    odd = ["", " ", "a  b", " a", "a ", "a \nb\n\n\nc", "x<|endoftext|> y <|startoftext|>z", "don't  we'll IT'S", "é é ́x", "a\x1cb \x1c c\x85 d  e", "\t\t a", "ΣΑΣ Σ",
           "a　b 　c", "É é. ÀÇß,, x!?", "İi", "a\nb c\n", "\na", "ÿ. Ÿ ª µ", "日本 語 🙂 x", "a### b*** c_ d__ e-- f' g'' h'. i(j) k{ l| m~ n@ o% p\\ q^ r` Über!?*** x<| y</w>"]
    for t in odd + [t or "" for _, t, _ in rows]:
        assert np.frombuffer(e.ids(t), np.uint32).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_token_files(spark, docs, none, rows, tmp_path):
    path = public.path("word_bpe_49k.json")
    t = tokenizers.Tokenizer.from_file(path)
    want, before = [], 0
    digest = lambda t: np.uint64(xxhash.xxh64_intdigest((t or "").encode(), 42)).astype(np.int64)
    for d, text, _ in sorted(rows, key=lambda r: (plain.later(r[0]), digest(r[1]))):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((d, before, len(ids), plain.crc(ids)))
        before += len(ids)
    rans.write_token_files(docs, str(tmp_path / "a"), path, spaced=False, end_id=2, block_ids=500)
    same(rans.read_token_files(spark, str(tmp_path / "a")).select("doc", "start", "n_tokens", F.crc32("ids")).collect(), want)
    rans.write_token_files(none, str(tmp_path / "b"), path, spaced=False, end_id=2)
    assert rans.read_token_files(spark, str(tmp_path / "b")).count() == 0


def test_quality(spark, docs, none, rows):
    labels = spark.createDataFrame([(r[0], int(k % 3 > 0), 0) for k, r in enumerate(rows[:40])] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    got = quality.quality_verdicts(docs, labels).collect()
    want = [(d, *plain.quality(t)) for d, t, _ in rows]
    same([(r.doc, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got], want)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.score >= r.threshold)
    assert quality.quality_verdicts(none, labels).count() == 0
    plainly = quality.quality_verdicts(docs, labels.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) for r in plainly)


def test_quality_score_tells_trusted_texts_from_others(spark):
    rng = random.Random(3)
    good = [(k, sentence(rng, 80, 200)) for k in range(120)]
    bad = [(1000 + k, " ".join(f"z{rng.randrange(200)}" for _ in range(80))) for k in range(60)]
    labels = spark.createDataFrame([(k, 1, 0) for k, _ in good[:60]] + [(k, 0, 0) for k, _ in bad[:20]], "doc_id long, quality int, toxic int")
    got = {r.doc: r.kept for r in quality.quality_verdicts(spark.createDataFrame(good + bad, "doc_id long, text string"), labels).collect()}
    assert sum(got[k] for k, _ in good) >= 118 and sum(got[k] for k, _ in bad) <= 1


def test_likelihood_weights_equal_direct_counts(spark):
    texts = [(0, "a b a"), (1, "b c"), (2, "c c d")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    w = quality.ngram_weights(docs, [0])
    raw, target = np.zeros((2, len(w)))
    for k, t in texts:
        buf = np.frombuffer(t.encode(), np.uint8)
        starts, ends, first = words.spans(buf, np.array([0, len(buf)]))
        bucket, _ = quality._buckets(words.word_hashes(buf, starts, ends), first)
        np.add.at(raw, bucket, 1)
        if k == 0:
            np.add.at(target, bucket, 1)
    p = lambda c: np.log((c + 1) / (c.sum() + len(c)))
    assert np.allclose(w, p(target) - p(raw))


def test_mixing(spark, docs, none, rows):
    sizes = mixing.document_sizes(docs)
    got = mixing.taken_words(sizes).collect()
    size = lambda t: len(plain.spaces(t))
    total = {}
    for _, t, s in rows:
        total[s] = total.get(s, 0) + size(t)
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), sum(total.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * total[s]}
        target |= {s: 3 * total[s] for s in over} if over else share
        if not over:
            break
        left -= sum(3 * total[s] for s in over)
        free -= over
    source = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        s = next(x for x in order if total[x] == r.source_size and abs(target[x] - r.target) < 1e-6)
        source[s] = source.get(s, 0) + r.taken
    assert all(abs(source[s] - target[s]) <= 1 for s in order)
    same([(r.doc, r.size) for r in got], [(d, size(t)) for d, t, _ in rows])
    again = mixing.taken_words(mixing.document_sizes(docs.repartition(2))).collect()
    same([(r.doc, r.size, r.taken) for r in got if r.doc is not None], [(r.doc, r.size, r.taken) for r in again if r.doc is not None])
    assert mixing.taken_words(mixing.document_sizes(none)).count() == 0


def test_schedule_is_in_order_of_virtual_finish_time(docs):
    schedule, _ = mixing.mix_schedule(mixing.document_sizes(docs))
    rows = schedule.collect()
    assert [r.finish for r in rows] == sorted(r.finish for r in rows) and all(r.finish <= 1 for r in rows)


def test_best_fit_and_bound():
    rng = np.random.default_rng(4)
    for n in (0, 1, 7, 300):
        lengths = rng.integers(1, 100, n)
        bins, offsets = packing.best_fit(lengths, 100)
        made = int(bins.max(initial=-1)) + 1
        for b in range(made):
            at = np.argsort(offsets[bins == b])
            sizes = lengths[bins == b][at]
            assert offsets[bins == b][at].tolist() == (np.cumsum(sizes) - sizes).tolist() and sizes.sum() <= 100
        assert packing.lower_bound(lengths, 100) <= made
    assert packing.lower_bound(np.array([60] * 5), 100) == 5
    assert packing.lower_bound(np.array([34] * 6), 100) == 3


def test_packing(spark, docs, none, rows):
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    want = []
    for d, text, _ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        cut = [0, *range(len(ids) - (len(ids) - 1) // 2048 * 2048, len(ids) + 1, 2048)]
        want += [(d, k, a, b - a, plain.crc(ids[a:b])) for k, (a, b) in enumerate(zip(cut, cut[1:]))]
    got = packing.packed_documents(docs).collect()
    same([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], want)
    seen = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert seen.get(r.sequence_id, 0) == r.offset
        seen[r.sequence_id] = r.offset + r.length
    assert max(seen.values()) <= 2048
    assert len(seen) <= packing.lower_bound(np.array([r.length for r in got]), 2048) + 1
    assert packing.packed_documents(none).count() == 0


def test_packing_exchanges_pieces_of_groups_with_gaps(spark):
    rng = random.Random(8)
    lengths = [rng.randrange(1, 60) for _ in range(900)]
    pieces = spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "uid long, length long")
    apart = packing.pack(pieces, 100, group_rows=30, rounds=0).select("sequence_id").distinct().count()
    got = packing.pack(pieces, 100, group_rows=30).collect()
    assert len({r.sequence_id for r in got}) < apart and sorted(r.uid for r in got) == list(range(900))


def vectors_of(rng):
    centres = rng.normal(size=(60, 16))
    x = [c + rng.normal(size=16) * 0.05 for c in centres for _ in range(4)]
    x += [centres[0] + rng.normal(size=16) * 0.04 for _ in range(90)] + [centres[1]] * 30 + [3 * centres[2], -centres[2]]
    return [(k, [float(v) for v in row]) for k, row in enumerate(np.array(x, np.float32))]


def test_embedding_links(spark):
    rows = vectors_of(np.random.default_rng(6))
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [float("inf")] + [1.0] * 15), (905, [None] * 16), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (None, rows[0][1]), rows[5], rows[5]]
    v = spark.createDataFrame([(a, b, 1, 2) for a, b in rows + odd], "vec_id long, embedding array<float>, shard int, rep int").repartition(3)
    got = vectors.near_duplicate_vectors(v, shard_rows=32, audit_rows=64).collect()
    live = rows + [rows[5], rows[5]]
    x = np.array([b for _, b in live], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    where = plain.groups(list(range(len(live))), lambda i, j: near[i, j])
    want = [(a, int(near[i].sum()) - 1, live[where[i]][0]) for i, (a, _) in enumerate(live)]
    want += [(a, 0, a) for a, _ in odd[:6]] + [(906, 1, 906), (907, 1, 906), (None, 0, None)]
    out = [(r.vec_id, r.n_links, r.component) for r in got]
    assert len(out) == len(want)
    exact = {(a, c) for a, _, c in out} == {(a, c) for a, _, c in want}
    met = sum(min(n, dict((a, m) for a, m, _ in want)[a]) for a, n, _ in out)
    assert exact and met >= 0.95 * sum(n for _, n, _ in want) and all(r.audit_recall >= 0.9 for r in got)
    assert all(n <= dict((a, m) for a, m, _ in want)[a] for a, n, _ in out)
    assert vectors.near_duplicate_vectors(v.limit(0)).count() == 0


def test_graph_reaches_every_node_and_finds_ranges():
    x = np.array([b for _, b in vectors_of(np.random.default_rng(7))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near, medoid = graph.build(x)
    seen, todo = {medoid}, [medoid]
    while todo:
        for k in near[todo.pop()].tolist():
            if k not in seen:
                seen.add(k)
                todo.append(k)
    assert len(seen) == len(x)
    q, n = graph.range_search(x, graph.padded(near), medoid, x, np.full(len(x), -1), 0.95, 16)
    truth = x @ x.T >= 0.95
    assert truth[q, n].all() and len(set(zip(q.tolist(), n.tolist()))) == len(q) >= 0.9 * truth.sum()


def test_vectors_that_share_an_id_are_nodes_of_their_own(spark):
    rows = [(5, [1.0, 0.0]), (5, [1.0, 0.001]), (7, [0.0, 1.0]), (7, [1.0, 0.0, 0.0]), (3, [0.001, 1.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0]), (2, [-1.0, 0.0]), (2, [-1.0, 0.0005])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.n_links, r.component) for r in vectors.near_duplicate_vectors(v).collect()]
    same(got, [(5, 3, 5), (5, 3, 5), (7, 1, 3), (7, 0, 7), (3, 1, 3), (9, 3, 5), (9, 3, 5), (2, 1, 2), (2, 1, 2)])


def test_recall_below_the_bar_is_not_returned(spark, monkeypatch):
    monkeypatch.setattr(vectors, "_exact", lambda batches, audited, floor: iter([pa.RecordBatch.from_pydict({"rep": pa.array([1], pa.int64()), "n": pa.array([1000], pa.int64())})]))
    v = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(20)], "vec_id long, embedding array<double>")
    with pytest.raises(RuntimeError, match="recall"):
        vectors.near_duplicate_vectors(v, tries=1)


def test_nearest_pivots():
    near = np.random.default_rng(1).normal(size=(50, 9)).round(1)
    assert (vectors._nearest(near, 4) == np.argsort(-near, axis=1, kind="stable")[:, :4]).mean() > 0.95
    assert (vectors._nearest(near, 9) == np.argsort(-near, axis=1, kind="stable")).all()
