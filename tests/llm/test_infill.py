"""Fill-in-middle against a plain version, for both units, and the registered query on a small folder."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import infill, queries

SCHEMA = "doc_id long, text string, n int, form string, output string, h1 int, `a.b` int"


def plain(doc, text, unit="token"):
    t = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", t, re.S) if unit == "token" else list(t)
    n = len(units)
    x = hashlib.sha256(f"1:{'null' if doc is None else doc}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not t or any(k in t for k in infill.MARKERS) or h[2] % 100 >= 90:
        return doc, n, "plain", None, None, t
    if h[3] % 100 < 20:
        return doc, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def corpus():
    rng = random.Random(3)
    letters = "abcXYZ  \n\t019.<>é你𝄞́\x00"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(120)]
    texts += ["", None, "a", "é", "𝄞𝄞", "has <P> in it", "<S>", "x<M>y", "<", "<P", "ab<", "word " * 30_000, "é" * 70_000]
    rows = [(k, t) for k, t in enumerate(texts)]
    return rows + [(None, "no id"), (None, "none either é"), (5, "second text of five"), rows[7], rows[7]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, 1, "x", "y", 2, 3) for d, t in corpus()], SCHEMA).repartition(3)


def test_index_converts_both_ways():
    text = "aé你𝄞b" * 5 + "tail"
    index = infill.Exceptions(np.frombuffer(text.encode(), np.uint8))
    cuts = np.arange(len(text) + 1)
    at = np.array([len(text[:c].encode()) for c in cuts])
    assert (index.to_bytes(cuts) == at).all() and (index.to_chars(at) == cuts).all()


@pytest.mark.parametrize("unit", ["token", "char"])
def test_fill_in_middle(docs, unit):
    made = infill.fill_in_middle(docs, unit=unit)
    got = [tuple(r) for r in made.collect()]
    want = [plain(d, t, unit) for d, t in corpus()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = made.select("doc", infill.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted(((r.doc, r.text) for r in back), key=str) == sorted(((d, t or "") for d, t in corpus()), key=str)


def test_no_rows_and_other_markers(spark, docs):
    assert infill.fill_in_middle(docs.limit(0)).count() == 0
    marks = ("[pre]", "[suf]", "[mid]")
    made = infill.fill_in_middle(docs, markers=marks, joint_percent=100)
    assert made.where("form = 'plain'").select("output").distinct().collect()[0].output == ""
    back = made.select(infill.restored(F.col("output"), F.col("form"), marks).alias("text"))
    assert sorted(r.text for r in back.collect()) == sorted(t or "" for _, t in corpus())
    with pytest.raises(ValueError):
        infill.fill_in_middle(docs, unit="word")


def test_registered_query(spark, docs, tmp_path):
    docs.drop("a.b").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op12_fill_in_middle"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(*plain(d, t)[:5], sha(plain(d, t)[5]), sha(t or "")) for d, t in corpus()]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
