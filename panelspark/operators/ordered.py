"""Exact ranks, quantiles and running sums inside groups of any size.

A plain window over a cross-section puts a whole date in one task. Here a group
is first cut into value ranges. The cuts come from a hash-chosen sample of the
distinct values, so they depend on nothing but the data and a recomputed task
sees the same cuts. Ties are collapsed by a map-side aggregation, each range is
ordered on its own, and the ranges are stitched with their offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.sources.files import materialize

SAMPLE_EVERY = 4096  # one distinct value in this many is sampled to place the cuts
VALUES_PER_RANGE = 16  # sampled values per range: about 65,000 distinct values are ordered together


def _nn(keys: list[str]) -> list[Column]:
    return [F.col(k) for k in keys]


def value_positions(df: DataFrame, keys: list[str], value: str, every: int = SAMPLE_EVERY, per_range: int = VALUES_PER_RANGE) -> DataFrame:
    """One row per (keys, distinct non-null value) with lt = rows below, eq = rows at the value, n = group rows.

    The sampled values of a group are 1/4096 of its distinct values, so a group of a billion values sends
    two megabytes of cuts; a small group has none and is ordered whole. All branches read the same
    aggregated exchange with the same columns, n among them, which lets Spark run it once.
    """
    vals = (
        df.select(*_nn(keys), F.col(value).alias("_v")).dropna(subset=[*keys, "_v"])
        .groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("eq"))
    )
    picked = F.array_sort(F.collect_list(F.when(F.pmod(F.xxhash64("_v"), F.lit(every)) == 0, F.col("_v"))))
    stats = vals.groupBy(*keys).agg(F.sum("eq").alias("n"), picked.alias("_s"))
    stats = stats.withColumn("_cuts", F.filter("_s", lambda x, i: i % per_range == 0)).drop("_s")
    ranged = vals.join(stats, keys).withColumn("_r", _below("_cuts", F.col("_v"))).drop("_cuts")
    inside = Window.partitionBy(*keys, "_r").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(*keys, "_r").agg(F.sum("eq").alias("_c"), F.max("n").alias("_n")).select(
        *_nn(keys), "_r", "_n", F.coalesce(F.sum("_c").over(across), F.lit(0)).alias("_off")
    )
    return (
        ranged.withColumn("_in", F.coalesce(F.sum("eq").over(inside), F.lit(0)))
        .join(offsets, [*keys, "_r"])
        .select(*_nn(keys), F.col("_v").alias(value), (F.col("_in") + F.col("_off")).alias("lt"), "eq", F.greatest("n", "_n").alias("n"))
    )


def _below(cuts: str, value: Column) -> Column:
    """How many of the ascending cuts are below the value, by binary search."""
    n = F.size(cuts)
    start = F.struct(F.lit(0).alias("lo"), n.alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        above = (s["lo"] < s["hi"]) & (F.get(cuts, mid) < value)
        lo = F.when(above, mid + 1).otherwise(s["lo"])
        hi = F.when((s["lo"] < s["hi"]) & ~above, mid).otherwise(s["hi"])
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    rounds = F.sequence(F.lit(1), F.ceil(F.log2(n + 1)).cast("int"))
    return F.when(n == 0, F.lit(0)).otherwise(F.aggregate(rounds, start, halve, lambda s: s["lo"]))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Linear-interpolation quantiles per group, one row per group, plus the non-null count n."""
    pos = value_positions(df, keys, value)
    aggs, outs = [], []
    for name, q in qs.items():
        p = F.lit(float(q)) * (F.col("n") - 1)
        lo, hi = F.floor(p), F.ceil(p)
        at = lambda i: (F.col("lt") <= i) & (i < F.col("lt") + F.col("eq"))
        aggs += [
            F.max(F.when(at(lo), F.col(value))).alias(f"_{name}_lo"),
            F.max(F.when(at(hi), F.col(value))).alias(f"_{name}_hi"),
        ]
        frac = F.lit(float(q)) * (F.col("n") - 1) - F.floor(F.lit(float(q)) * (F.col("n") - 1))
        outs.append((F.col(f"_{name}_lo") + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * frac).alias(name))
    return pos.groupBy(*keys).agg(F.max("n").alias("n"), *aggs).select(*_nn(keys), "n", *outs)


def average_rank(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Add `out` = average-tie rank / non-null count; NULL values get NULL.

    Heavy values, those with more than a quarter of a partition's share of all rows, are found by count; there can be no more than
    four a partition, so their ranks are broadcast and their rows stay where they are. The other rows meet their rank by
    value, and no value among them has enough rows to fill a task; rows of heavy values and NULLs pass that shuffle spread by their content.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rank = ((F.col("lt") + (F.col("eq") + 1) / 2.0) / F.col("n")).alias(out)
    # the constant is written with the rest: as a literal it would be folded out of the join's keys
    pos = materialize(value_positions(df, keys, value).select(*_nn(keys), value, "eq", F.lit(0).alias("_spread"), rank), "positions")
    total = pos.agg(F.sum("eq")).first()[0] or 0
    often = F.col("eq") > max(1, total // (4 * n))
    heavy = F.broadcast(pos.filter(often).select(*_nn(keys), value, F.col(out).alias("_heavy")))
    light = pos.filter(~often).select(*_nn(keys), value, "_spread", F.col(out).alias("_light"))
    found = df.join(heavy, [*keys, value], "left")
    spread = F.when(F.col(value).isNotNull() & F.col("_heavy").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*df.columns), F.lit(4 * n)).cast("int"))
    found = found.withColumn("_spread", spread).join(light, [*keys, value, "_spread"], "left")
    return found.select(*[F.col(c) for c in df.columns], F.coalesce("_heavy", "_light").alias(out))


def unpivot(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    return df.unpivot(keys, [F.col(c).cast("double").alias(c) for c in cols], "_col", "_val")


def repivot(long: DataFrame, keys: list[str], cols: list[str], val: str, suffix: str = "") -> DataFrame:
    return long.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_col") == c, F.col(val))).alias(f"{c}{suffix}") for c in cols]
    )
