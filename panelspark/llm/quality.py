"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm import common, words

BUCKET_BITS = 16
_CODE_POINT = (np.arange(256) & 0xC0) != 0x80
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def _buckets(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word and word pair, and the document it is in."""
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pairs, at = words.ngrams(hashes, first, 2)
    cut = np.uint64(64 - BUCKET_BITS)
    return np.concatenate([hashes >> cut, pairs >> cut]).astype(np.int64), np.concatenate([of, of[at]])


def _count(batches: Iterator[pa.RecordBatch], trusted) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros((2, 1 << BUCKET_BITS), np.int64)
    for batch in batches:
        ids = batch.column("doc")
        good = np.isin(ids.fill_null(0).to_numpy(), trusted.value) & ids.is_valid().to_numpy(zero_copy_only=False)
        for a, b, buf, offsets in words.text_blocks(batch, "body"):
            starts, ends, first = words.spans(buf, offsets)
            bucket, of = _buckets(words.word_hashes(buf, starts, ends), first)
            raw += np.bincount(bucket, minlength=len(raw))
            target += np.bincount(bucket[good[a:b][of]], minlength=len(raw))
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])


def ngram_weights(docs: DataFrame, trusted_ids: list[int], id_col: str = "doc_id", text_col: str = "text", smoothing: float = 1.0) -> np.ndarray | None:
    """log p(bucket | trusted) - log p(bucket | all) for each of 2^16 buckets; None without trusted words.

    Counts cover every word and word pair of every document. Tasks send one sum per bucket, so what reaches
    the driver is 2^16 rows at any corpus size.
    """
    spark = docs.sparkSession
    trusted = spark.sparkContext.broadcast(np.array(sorted(trusted_ids), dtype=np.int64))
    d = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("body"))
    sums = d.mapInArrow(lambda it: _count(it, trusted), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    found = sums.toPandas()
    raw, target = np.zeros((2, 1 << BUCKET_BITS), np.float64)
    raw[found["bucket"]], target[found["bucket"]] = found["raw"], found["target"]
    if not target.sum():
        return None
    share = lambda x: np.log(x + smoothing) - np.log(x.sum() + smoothing * len(x))
    return share(target) - share(raw)


def _repeats(hashes: np.ndarray, first: np.ndarray, n: int = 3) -> np.ndarray:
    """Per document: words that lie in a window of n words found twice or more in it."""
    gram, at = words.ngrams(hashes, first, n)
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((gram, of[at]))
    key, doc = gram[order], of[at][order]
    same = (key[1:] == key[:-1]) & (doc[1:] == doc[:-1]) if len(key) else np.zeros(0, bool)
    twice = np.zeros(len(key), bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered = np.zeros(len(hashes), bool)
    for k in range(n):
        covered[at[order[twice]] + k] = True
    return words.per_document(covered, first)


def _repeated_lines(text: bytes) -> int:
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line.strip():
            n += line in seen
            seen.add(line)
    return n


def _features(batches: Iterator[pa.RecordBatch], weights) -> Iterator[pa.RecordBatch]:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for batch in batches:
        for a, b, buf, offsets in words.text_blocks(batch, "body"):
            starts, ends, first = words.spans(buf, offsets)
            hashes = words.word_hashes(buf, starts, ends)
            whole = buf.tobytes()
            lines = [_repeated_lines(whole[i:j]) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            chars = words.per_document(_CODE_POINT[buf] & words.IS_WORD[buf], offsets)
            figures = [np.diff(first), chars, words.per_document(_SYMBOL[buf], offsets), np.array(lines), _repeats(hashes, first)]
            score = np.zeros(b - a)
            if weights.value is not None:
                bucket, of = _buckets(hashes, first)
                score = np.bincount(of, weights.value[bucket], b - a) / np.maximum(np.bincount(of, minlength=b - a), 1)
            own = [c for c in batch.schema.names if c != "body"]
            cols = [*(batch.column(c).slice(a, b - a) for c in own), *(pa.array(x.astype(np.int64)) for x in figures), pa.array(score)]
            yield pa.RecordBatch.from_arrays(cols, [*own, *names, "score"])


def quality_scores(docs: DataFrame, weights: np.ndarray | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc, digest (common.digest of the text), the text's counts and score, the mean weight of its words and word pairs (0 without any).

    A null text has no words. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    schema = "doc long, digest long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"
    d = docs.select(F.col(id_col).cast("long").alias("doc"), common.digest(F.col(text_col)).alias("digest"), F.col(text_col).alias("body"))
    return d.mapInArrow(lambda it: _features(it, shared), schema)


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def threshold(scored: DataFrame, labels: DataFrame, max_rows: int = 20_000, loss: float = 20.0) -> float:
    """The score at which labelled documents split best, a lost good one counting loss times a kept bad one.

    labels(doc, quality) are documents that the target model has not seen; a hash-chosen sample of at most max_rows takes part. The
    cut is half-way down to the next lower score, so good documents a little below the labelled ones stay; among equally good
    cuts the lowest wins, and without bad labels everything stays.
    """
    sample = _sample(labels.where("quality in (0, 1)"), max_rows)
    rows = scored.where(~base_failed()).join(F.broadcast(sample), "doc").select("score", "quality").toPandas()
    good, bad = (np.sort(rows.loc[rows["quality"] == q, "score"].to_numpy()) for q in (1, 0))
    at = np.unique(np.concatenate([good, bad]))
    if not len(at):
        return float("-inf")
    cost = loss * np.searchsorted(good, at, "left") + len(bad) - np.searchsorted(bad, at, "left")
    best = int(np.argmin(cost))
    return float((at[best] + at[best - 1]) / 2) if best else float("-inf")


def _sample(labels: DataFrame, max_rows: int) -> DataFrame:
    return labels.where("doc is not null").orderBy(F.xxhash64("doc"), "doc").limit(max_rows)


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_trusted: int = 20_000) -> DataFrame:
    """Id, text digest, counts, score, base_failed and kept for every row of docs.

    labels(doc_id, quality, toxic): half of the documents with quality 1 that are not marked toxic, by hash and at most
    max_trusted, are the trusted target; the raw model is the whole corpus. The other labels, a bounded sample
    too, give the threshold. kept is false for base failures and for scores below the threshold. Without trusted
    documents every document that passes the base rules stays.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc"), "quality", F.coalesce("toxic", F.lit(0)).alias("toxic"))
    marks = marks.groupBy("doc").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    target = (F.col("quality") == 1) & (F.col("toxic") == 0) & (F.pmod(F.xxhash64("doc", F.lit(1)), F.lit(2)) == 0)
    trusted = [r["doc"] for r in _sample(marks.where(target), max_trusted).select("doc").collect()]
    weights = ngram_weights(docs, trusted, id_col, text_col) if trusted else None
    scored = common.land(quality_scores(docs, weights, id_col, text_col), "quality")
    cut = threshold(scored, marks.where(~target)) if weights is not None else float("-inf")
    failed = base_failed()
    return scored.select("*", failed.alias("base_failed"), (~failed & (F.col("score") >= cut)).alias("kept"), F.lit(cut).alias("threshold"))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return quality_verdicts(docs, common.table(spark, sf_dir, "labels")).drop("digest").withColumnRenamed("doc", "doc_id")
