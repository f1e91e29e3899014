"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm import common

WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = 3) -> DataFrame:
    """sizes(source, size) -> one row per source: source, source_size, target.

    Sources by code point (null last) weigh the given weights in turn and share the sum of all sizes; a target
    stops at repeats times its source's size and the excess is shared again. With the sources ordered by
    cap / weight, each prefix taken as capped leaves one level for the rest, and the largest of these levels is
    the one at which none is above its cap: no loop is needed. The windows below run over one row per source.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), turn % len(weights) + 1)
    s = total.select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * repeats).alias("cap"))
    order = Window.orderBy(F.col("cap").cast("double") / F.col("weight"), F.asc_nulls_last("source"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = left.cast("double") / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).cast("double")
    s = s.withColumn("level", level).withColumn("level", F.max("level").over(whole))
    return s.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def mix_schedule(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = 3, seed: str = "mix-1"
) -> tuple[DataFrame, DataFrame]:
    """sizes(uid, doc, source, size) -> (schedule, per-row source figures).

    schedule: one row per document and pass that the mix takes, in global order of virtual finish time:
    uid, pass, start, finish (cumulative words of the source over its target) and taken words. A document that
    crosses its source's target is taken in part, so each source gets its target to within a word.

    Documents are shuffled by md5(seed, doc). The running sum of a source never sits in one task: hash prefixes
    are summed first, offsets are running sums over at most 16^digits prefixes, and rows are
    summed inside a prefix; digits follows the row count and does not change the result. Empty documents and
    sources take nothing; equal rows are ordered by size and row id.
    """
    rows = sizes.count()
    digits = 2
    while rows > 20_000 * 16**digits:
        digits += 1
    draw = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc").cast("string"), F.lit("null")))), 1, 16)
    s = sizes.withColumn("draw", draw).withColumn("prefix", F.substring("draw", 1, digits))
    targets = source_targets(sizes, weights, repeats)
    by_prefix = s.groupBy("source", "prefix").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_prefix.select(F.col("source").alias("__s"), F.col("prefix").alias("__p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__o"))
    offsets = offsets.join(targets.select(F.col("source").alias("__t"), "source_size", "target"), F.col("__s").eqNullSafe(F.col("__t")))
    inside = Window.partitionBy("source", "prefix").orderBy("draw", "doc", "size", "uid").rowsBetween(Window.unboundedPreceding, -1)
    placed = s.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(offsets, F.col("source").eqNullSafe(F.col("__s")) & (F.col("prefix") == F.col("__p")))
    placed = placed.select("uid", "doc", "source", "size", "source_size", "target", (F.col("start") + F.col("__o")).alias("start"))
    passes = placed.where("size > 0 and target > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    passes = passes.withColumn("start", F.col("start") + F.col("pass") * F.col("source_size"))
    taken = F.least(F.col("size"), F.floor("target") - F.col("start"))
    schedule = passes.withColumn("taken", taken).where("taken > 0").select(
        "uid", "doc", "source", "pass", (F.col("start") / F.col("target")).alias("start"),
        ((F.col("start") + F.col("taken")) / F.col("target")).alias("finish"), "taken",
    )
    return schedule.orderBy("finish", "doc", "pass", "uid"), placed.drop("start")


def text_size(text: Column) -> Column:
    """Words of a text; a missing one has none."""
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def document_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(uid, doc, source, size): size counts the words of the text, null has none. Landed, so uid is stable."""
    size = text_size(F.col(text_col))
    return common.land(docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc"), F.col(source_col).alias("source"), size.alias("size")), "sizes")


def taken_words(sizes: DataFrame, **options) -> DataFrame:
    """Per row of sizes: uid, doc, size, source_size, target and the words taken over all passes."""
    schedule, placed = mix_schedule(sizes, **options)
    words = schedule.groupBy("uid").agg(F.sum("taken").alias("taken"))
    return placed.join(words, "uid", "left").select("uid", "doc", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    sizes = document_sizes(common.table(spark, sf_dir, "documents"))
    return taken_words(sizes).select(F.col("doc").alias("doc_id"), "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 16) AS draw
  FROM documents
), total AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM sizes GROUP BY source
), capped AS (
  SELECT source, source_size, [5, 2, 1][turn % 3 + 1]::BIGINT AS weight, source_size * 3 AS cap FROM total
), leveled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM capped WINDOW o AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST)
), targets AS (
  SELECT source, source_size, least(cap::DOUBLE, max(level) OVER () * weight) AS target FROM leveled
), placed AS (
  SELECT doc_id, size, source_size, target,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(size, floor(target)::BIGINT - start)) + greatest(0, least(size, floor(target)::BIGINT - start - source_size))
   + greatest(0, least(size, floor(target)::BIGINT - start - 2 * source_size)))::BIGINT AS taken
FROM placed
"""
