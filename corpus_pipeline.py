"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing and packing, each stage on what the one before kept.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import common, lines, mixing, packing, quality, similar

#: No stage of a fitted model can be stated in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def _kept(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of docs whose id, a missing one included, and text are in keys(doc, digest). Any other columns pass, whatever their names."""
    doc, digest = common.spare(docs, "doc", "digest")
    keys = keys.select(F.col("doc").alias(doc), F.col("digest").alias(digest))
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (common.digest(F.col("text")) == F.col(digest))
    return docs.join(keys, same, "left_semi")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood-ratio threshold. Rows without an id, or that share one, stay or go each by its own text."""
    verdicts = quality.quality_verdicts(docs, common.table(spark, sf_dir, "labels"))
    return _kept(docs, verdicts.where("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a line in ten or more documents the first occurrence stays. Documents left without a word go, n_chars is counted anew."""
    n_lines, n_dropped = common.spare(docs, "n_lines", "n_dropped")
    cut = lines.apply_bitmaps(docs, lines.repeated_line_bitmaps(docs, min_docs=10, min_chars=1, keep_first=True), counts=(n_lines, n_dropped))
    left = cut.where(F.length(common.strip(F.col("text"))) > 0)

    def column(c: str):
        if c != "n_chars":
            return common.named(c)
        return F.when(F.col(n_dropped) > 0, F.char_length("text")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c)

    return left.select(*map(column, docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id, once. Groups are of texts, so rows of different groups stay whatever their ids.

    Five-word shingles; sets link at a Jaccard similarity of 0.8 or more, compared in full among those that fingerprints within seven of 64 bits or a shared band of min-hashes connect.
    """
    found = similar.similar_documents(docs, shingle=5, similarity=0.8, limit=7)
    first = F.min(F.struct(F.col("doc").isNull().alias("missing"), "doc", "digest")).alias("first")
    kept = found.groupBy("root").agg(first).select("first.doc", "first.digest")
    (digest,) = common.spare(docs, "digest")
    once = _kept(docs, kept).withColumn(digest, common.digest(F.col("text")))
    return once.dropDuplicates(["doc_id", digest]).drop(digest)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mix, as often as it takes them: words taken over size, rounded, so only the document at its source's target is rounded.

    A source's first document in the mix is taken once at least, so no source with a target vanishes because one large document crosses it.
    Every row has a number of its own, so rows that share an id or a text are taken each for itself.
    """
    uid, times = common.spare(docs, "uid", "times")
    rows = common.land(docs.withColumn(uid, F.monotonically_increasing_id()), "mix")
    size = mixing.text_size(F.col("text"))
    sizes = rows.select(F.col(uid).alias("uid"), F.col("doc_id").alias("doc"), F.col("source"), size.alias("size"))
    schedule, placed = mixing.mix_schedule(common.land(sizes, "sizes"))
    taken = schedule.groupBy("uid").agg(F.sum("taken").alias("taken"), F.min("start").alias("first")).join(placed.select("uid", "size"), "uid")
    often = F.greatest(F.round(F.col("taken") / F.col("size")), F.when(F.col("first") == 0, 1).otherwise(0)).cast("int")
    mixed = rows.join(taken.select(F.col("uid").alias(uid), often.alias(times)).where(F.col(times) > 0), uid)
    copies = F.explode(F.sequence(F.lit(1), F.col(times)))
    return mixed.withColumn(times, copies).select(*map(common.named, docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their places in sequences of 2048."""
    return packing.packed_documents(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("best_fit_packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each one's rows are written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.land(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
