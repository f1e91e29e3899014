"""The corpus pipeline's stages on a small corpus with planted copies, passages and junk."""

from __future__ import annotations

import random

import plain
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    path = str(tmp_path_factory.mktemp("corpus"))
    clean = [words(rng, rng.randrange(80, 200)) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(clean)]
    rows += [(100 + k, clean[k]) for k in range(8)]
    rows += [(200 + k, clean[10 + k].replace(" ", " x ", 1)) for k in range(8)]
    rows += [(300 + k, "### $$$ %%% " * 40 + words(rng, 30)) for k in range(20)]
    rows += [(400 + k, words(rng, 60) + "\nClick here to go on\n" + words(rng, 20)) for k in range(12)]
    rows += [(500, None), (501, ""), (None, words(rng, 90))]
    d = spark.createDataFrame([(k, t, "en", f"s{(k or 0) % 3}", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    d.repartition(4).write.parquet(f"{path}/documents.parquet")
    labels = [(k, 1, 0) for k in range(0, 60, 2)] + [(k, 0, 0) for k in range(300, 312)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[name] = docs.collect()
    ids = {name: [r.doc_id for r in rows] for name, rows in kept.items()}
    assert not [k for k in ids["quality_rules"] if k is not None and 300 <= k < 320 or k in (500, 501)]
    assert set(range(60)) <= set(ids["quality_rules"]) and None in ids["quality_rules"]
    assert sum("Click here" in r.text for r in kept["line_dedup"]) == 1 and set(range(60)) <= set(ids["line_dedup"])
    assert set(range(60)) <= set(ids["near_dedup"]) and not [k for k in ids["near_dedup"] if k is not None and 100 <= k < 300]
    assert len(ids["near_dedup"]) == len(set(ids["near_dedup"]))
    assert set(ids["mix_sources"]) <= set(ids["near_dedup"])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert sorted({r.doc_id or -1 for r in packed.collect()}) == sorted({k or -1 for k in ids["mix_sources"]})


def test_run_on_empty_documents(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def shingles(text, n=5):
    w = text.lower().split()
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_drifting_copies_go_link_by_link(spark, tmp_path):
    """Each text is near the next, in fingerprint too; the ends of a chain are far apart. All but the first go."""
    rng, rows = random.Random(5), []
    far = lambda a, b: bin(plain.simhash(a, 5) ^ plain.simhash(b, 5)).count("1")
    for chain in range(4):
        w = words(rng, 400).split()
        for step in range(12):
            rows.append((100 * chain + step, " ".join(w)))
            while True:
                n = w[: 33 * step] + words(rng, 12).split() + w[33 * step + 12 :]
                if far(" ".join(w), " ".join(n)) <= 7:
                    break
            w = n
    rng.shuffle(rows)
    text = dict(rows)
    assert all(jaccard(shingles(text[100 * c]), shingles(text[100 * c + 11])) < 0.6 for c in range(4))
    assert all(jaccard(shingles(text[100 * c + k]), shingles(text[100 * c + k + 1])) >= 0.9 for c in range(4) for k in range(11))
    kept = corpus_pipeline.near_dedup(spark, frame(spark, rows), str(tmp_path)).collect()
    assert sorted(r.doc_id for r in kept) == [0, 100, 200, 300]


def test_near_dedup_follows_brute_force_from_0_8(spark, tmp_path):
    """Pairs on both sides of the bar: what goes is what shingle sets of 0.8 or more connect, no less and no more."""
    rng, rows = random.Random(8), []
    for k in range(200):
        w = words(rng, 300).split()
        n = w[:]
        for at in rng.sample(range(30), rng.randrange(2, 12)):
            n[10 * at] += "z"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(n))]
    near = [jaccard(shingles(rows[2 * k][1]), shingles(rows[2 * k + 1][1])) for k in range(200)]
    assert sum(0.8 <= x < 0.85 for x in near) >= 30 and sum(0.7 <= x < 0.8 for x in near) >= 30
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame(spark, rows), str(tmp_path)).collect()}
    assert kept == {2 * k for k in range(200)} | {2 * k + 1 for k, x in enumerate(near) if x < 0.8}


def test_rows_without_an_id_or_sharing_one_go_by_their_own_text(spark, tmp_path):
    rng = random.Random(3)
    a, b, c, d, e = (words(rng, 90) for _ in range(5))
    junk = "### $$$ %%% " * 40 + words(rng, 30)
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (8, e), (8, d), (3, d), (9, e), (9, junk), (None, junk)]
    docs = frame(spark, rows)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    passed = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    assert sorted(r.text for r in passed.collect()) == sorted(t for _, t in rows if t != junk)
    kept = corpus_pipeline.near_dedup(spark, frame(spark, rows[:-2]), str(tmp_path)).collect()
    assert sorted((r.doc_id or -1, r.text) for r in kept) == sorted([(-1, a), (-1, b), (7, c), (3, d), (8, e)])


def test_mixing_takes_each_row_for_itself(spark, tmp_path):
    """Two rows share an id and two a whole text; the second source's only document is far above its target and stays all the same."""
    rng = random.Random(6)
    rows = [(1, words(rng, 50), "a"), (1, words(rng, 40), "a"), (2, words(rng, 30), "a"), (2, None, "a"), (3, "", "a")]
    rows += [(3, rows[2][1], "a"), (3, rows[2][1], "a"), (None, words(rng, 20), "a"), (9, words(rng, 8000), "c"), (10, words(rng, 400), "b"), (11, words(rng, 10), None)]
    docs = spark.createDataFrame([(k, t, "en", s, len(t or "")) for k, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    mixed = corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).collect()
    sizes = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in ("a", "b", "c", None)}
    total, small = sum(sizes.values()), ("a", "b", None)
    assert all(3 * sizes[s] < total * w / 13 for s, w in zip(small, (5, 2, 5)))  # three sources stop at three times their size
    got = [(r.doc_id, r.text, r.source) for r in mixed]
    want = [r for r in rows if r[1] and r[2] != "c" for _ in range(3)] + [rows[8]]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_stages_pass_columns_of_any_name(spark, folder):
    names = ["n_lines", "N_dropped", "a.b", "doc", "digest", "uid", "times", "__doc", "x`y", "n", "keep"]
    plain_docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs = plain_docs
    for k, name in enumerate(names):
        docs = docs.withColumn(name, (docs["doc_id"] * 100 + k))
    for (name, stage), in zip(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[5 + k] == (None if r.doc_id is None else r.doc_id * 100 + k) for r in rows for k in range(len(names))), name
        assert sorted(map(str, (r[:5] for r in rows))) == sorted(map(str, (tuple(r) for r in stage(spark, plain_docs, folder).collect()))), name
    assert corpus_pipeline.pack(spark, docs, folder).count() > 0
