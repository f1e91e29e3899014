"""Line deduplication over hashes: the texts never move, per-document bitmaps come back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm import common


def line_occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """One row per line whose key has min_chars code points: (doc, digest, h1, h2, pos).

    The key is the line without ASCII white space at its ends and with A-Z lower-cased;
    h1 and h2 are independent hashes of it (96 bits). A null text is one empty line.
    digest tells rows that share an id but not a text apart.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc"), text.alias("body"))
    lines = d.select("doc", F.xxhash64("body").alias("digest"), F.posexplode(F.split("body", "\n", -1)).alias("pos", "line"))
    keyed = lines.select("doc", "digest", "pos", common.strip(common.ascii_lower(F.col("line"))).alias("key"))
    return keyed.where(F.char_length("key") >= min_chars).select("doc", "digest", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"), "pos")


def repeated_line_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False
) -> DataFrame:
    """Per document that loses lines: (doc, digest, n_dropped, keep_words).

    Lines whose key occurs in min_docs or more documents go; with keep_first the first
    one by (document, position) stays. keep_words lists (word, keep) for each 64-line word that is not all ones:
    bit i of word w is 1 if line 64 * w + i stays. Documents that lose nothing have no row.

    Hashes are range-partitioned together with a salt of the document, then sorted by document and position, so a
    line that a third of all documents share spreads over many tasks; each run streams past once and marks
    first occurrences, the runs' counts and firsts are then summed up per hash. Null ids count as one document, after
    all others; repeated rows count once.
    """
    spark = docs.sparkSession
    n = common.shuffle_partitions(spark)
    occ = line_occurrences(docs, id_col, text_col, min_chars).withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(n)).cast("int"))
    ranged = occ.repartitionByRange(n, "h1", "salt")
    run = Window.partitionBy("h1", "h2", "salt").orderBy(F.asc_nulls_last("doc"), "pos", "digest")
    seen = F.lag(F.struct("doc")).over(run)
    marked = common.land(ranged.select("*", (seen.isNull() | ~seen["doc"].eqNullSafe(F.col("doc"))).cast("int").alias("opens")), "lines")
    at = F.struct(F.col("doc").isNull().alias("last"), "doc", "pos", "digest")
    keys = marked.where("opens = 1").groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.min(at).alias("first")).where(F.col("n_docs") >= min_docs)
    hit = marked.join(keys, ["h1", "h2"])
    if keep_first:
        hit = hit.where(~(F.col("first.doc").eqNullSafe(F.col("doc")) & (F.col("first.pos") == F.col("pos")) & (F.col("first.digest") == F.col("digest"))))
    words = hit.groupBy("doc", "digest", F.expr("pos div 64").cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("drop")
    )
    return words.groupBy("doc", "digest").agg(
        F.sum(F.bit_count("drop")).cast("long").alias("n_dropped"),
        F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("drop").alias("keep")))).alias("keep_words"),
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """docs with text_col, after the other columns, cut to the lines its bitmap keeps, plus two long columns: lines before, and lines dropped.

    They are named by `counts`; columns of docs with these names would be lost, so they raise.
    """
    if {c.lower() for c in docs.columns} & {c.lower() for c in counts}:
        raise ValueError(f"docs has a column named like one of {counts}")
    key, mark, n, keep = common.spare(docs, "doc", "digest", "n", "keep")
    body = F.coalesce(common.named(text_col), F.lit(""))
    marks = bitmaps.select(F.col("doc").alias(key), F.col("digest").alias(mark), F.col("n_dropped").alias(n), F.col("keep_words").alias(keep))
    lines = F.split(body, "\n", -1)
    joined = docs.join(marks, common.named(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(body) == F.col(mark)), "left")
    words = F.map_from_entries(keep)

    def stays(_line, i):
        word = F.try_element_at(words, F.floor(i / 64).cast("int"))
        return word.isNull() | (word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (i % 64).cast("int"))) != 0)

    cut = F.when(F.col(keep).isNull(), body).otherwise(F.array_join(F.filter(lines, stays), "\n"))
    out = [common.named(c) for c in docs.columns if c.lower() != text_col.lower()]
    return joined.select(*out, cut.alias(text_col), F.size(lines).cast("long").alias(counts[0]), F.coalesce(n, F.lit(0)).cast("long").alias(counts[1]))


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = apply_bitmaps(docs, repeated_line_bitmaps(docs, min_docs=10, min_chars=1))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, pos, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM lines
), hot AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(hot.key)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE hot.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN hot USING (key) GROUP BY doc_id
"""
