"""Theme and industry composites, strength, life-cycle stages and leaders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.functions.rolling import rolling_z, series, trailing
from panelspark.operators.asof import asof
from panelspark.operators.flow import positive_streak

HORIZONS = (5, 20, 60, 120, 252)


def daily_returns(bars: DataFrame, key: str = "asset") -> DataFrame:
    """Return against the previous observation of the same series."""
    w = series(key)
    return bars.select(key, "d", "close", (F.try_divide(F.col("close"), F.lag("close").over(w)) - 1).alias("ret"))


def composite_returns(bars: DataFrame, members: DataFrame, key: str = "theme") -> DataFrame:
    """Equal-weight mean return and active member count per (theme, d).

    Averages are combined before the shuffle, so a theme that holds a third of all assets sends one row per task and day.
    """
    r = daily_returns(bars).join(members.select(key, "asset"), "asset")
    return r.groupBy(key, "d").agg(F.avg("ret").alias("ret"), F.count("close").alias("n_active"))


def theme_strength(ret: DataFrame, bench: DataFrame, key: str = "theme") -> DataFrame:
    """Cumulative returns over 5..252 rows, strength against the benchmark and its z-score."""
    wb = Window.partitionBy(F.lit(1)).orderBy("d")
    b = bench.select("d", (F.try_divide(F.col("close"), F.lag("close").over(wb)) - 1).alias("_b"))
    w = series(key)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    df = ret.join(b, "d", "left").withColumns({
        "_s": F.sum(F.log1p(F.coalesce("ret", F.lit(0.0)))).over(upto), "_sb": F.sum(F.log1p(F.coalesce("_b", F.lit(0.0)))).over(upto)})
    cum = lambda c, n: F.exp(F.col(c) - F.lag(c, n).over(w)) - 1
    cols = {f"abs_return_{n}d": cum("_s", n) for n in HORIZONS}
    cols |= {f"rs_kospi_{n}d": cum("_s", n) - cum("_sb", n) for n in (5, 20, 60, 252)}
    df = df.withColumns(cols)
    return df.withColumn("rs_kospi_20d_zscore_60d", rolling_z(F.col("rs_kospi_20d"), w, 60, 20)).drop("_s", "_sb", "_b")


def index_strength(index_bars: DataFrame, bench: DataFrame) -> DataFrame:
    """The same metrics on published index closes."""
    return theme_strength(daily_returns(index_bars, "index_id").select("index_id", "d", "ret"), bench, "index_id")


# Life-cycle thresholds.
STAGE = {"markup_rs20": 0.05, "markup_abs20": 0.0, "distribute_rs60": -0.02, "distribute_abs60": 0.0, "markdown_rs60": -0.05, "markdown_abs120": 0.0,
         "emergency_z": -2.5, "emergency_rs60": 0.0, "accumulate_abs60": 0.05, "accumulate_rs60": -0.02}


def lifecycle_stage(th: dict[str, float] = STAGE) -> Column:
    """Ordered rules; a rule on a missing metric does not hold."""
    rs20, rs60, z = F.col("rs_kospi_20d"), F.col("rs_kospi_60d"), F.col("rs_kospi_20d_zscore_60d")
    a20, a60, a120 = F.col("abs_return_20d"), F.col("abs_return_60d"), F.col("abs_return_120d")
    return (
        F.when((z <= th["emergency_z"]) & (rs60 <= th["emergency_rs60"]), "markdown")
        .when((rs60 < th["markdown_rs60"]) & (a120 < th["markdown_abs120"]), "markdown")
        .when((rs60 < th["distribute_rs60"]) & (a60 < th["distribute_abs60"]), "distribute")
        .when((rs20 > th["markup_rs20"]) & (a20 > th["markup_abs20"]), "markup")
        .when((F.abs(a60) < th["accumulate_abs60"]) & (rs60 > th["accumulate_rs60"]), "accumulate")
        .otherwise("transition")
    )


def lead_score() -> Column:
    return F.coalesce("rs_kospi_60d", F.lit(0.0)) + 0.5 * F.coalesce("rs_kospi_20d", F.lit(0.0))


def global_topk(df: DataFrame, score: str, k: int, tie: str, descending: bool = True) -> DataFrame:
    c = F.col(score)
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), tie).limit(k)


def stage_counts(snapshot: DataFrame) -> DataFrame:
    return snapshot.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


def stage_changes(panel: DataFrame, key: str = "theme", max_gap: int = 10) -> DataFrame:
    """Rows whose stage differs from the previous available day at most `max_gap` days back."""
    w = series(key)
    df = panel.withColumns({"previous_stage": F.lag("stage").over(w), "_pd": F.lag("d").over(w)})
    changed = (F.col("previous_stage") != F.col("stage")) & (F.datediff("d", "_pd") <= max_gap)
    return df.filter(changed).drop("_pd")


def industry_strength(bars: DataFrame, industry: DataFrame, mcap: DataFrame, leaders: int = 5, min_members: int = 3) -> DataFrame:
    """Equal-weight return of the largest members of each industry with at least three members."""
    latest = mcap.groupBy("asset").agg(F.max_by("market_cap", "snapshot_date").alias("mcap"))
    m = industry.join(latest, "asset", "left").withColumn("mcap", F.coalesce("mcap", F.lit(0.0)))
    big = m.groupBy("industry").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_members).select("industry")
    w = Window.partitionBy("industry").orderBy(F.col("mcap").desc(), "asset")
    top = m.join(big, "industry").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= leaders)
    n = top.groupBy("industry").agg(F.count(F.lit(1)).alias("n_leaders"))
    return composite_returns(bars, top, "industry").join(n, "industry").drop("n_active")


def quarterly_leaders(strength: DataFrame, k: int = 5, key: str = "theme") -> DataFrame:
    """Mean 60-row return per (quarter, theme) and the k best themes of each quarter.

    Means are rounded before ranking, so equal themes tie by name and not by the last bit of a sum.
    """
    q = strength.withColumn("quarter", F.concat(F.year("d").cast("string"), F.lit("Q"), F.quarter("d").cast("string")))
    m = q.groupBy("quarter", key).agg(F.round(F.avg("abs_return_60d"), 12).alias("mean_return_60d")).filter(F.col("mean_return_60d").isNotNull())
    w = Window.partitionBy("quarter").orderBy(F.col("mean_return_60d").desc(), key)
    return m.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def weekly(panel: DataFrame, key: str = "theme") -> DataFrame:
    """Last row of each calendar week per theme."""
    rest = [c for c in panel.columns if c not in (key, "d")]
    g = panel.groupBy(key, F.trunc("d", "week").alias("week")).agg(F.max_by(F.struct("d", *rest), "d").alias("_r"))
    return g.select(key, "week", "_r.*")


def bad_stage_streak(week: DataFrame, key: str = "theme", confirm: int = 3) -> DataFrame:
    w = series(key)
    bad = F.when(F.col("stage").isin("distribute", "markdown"), 1).otherwise(0)
    df = week.withColumn("_t", F.row_number().over(w)).withColumn("bad_streak", positive_streak(bad, w, F.col("_t"))).drop("_t")
    return df.withColumn("confirmed", F.col("bad_streak") >= confirm)


def entry_exit_signals(week: DataFrame, key: str = "theme", confirm: int = 3, hard_stop: float = -0.30) -> DataFrame:
    """Entry at the first markup week, exit on a confirmed bad streak or the hard stop against the entry level.

    `level` is the composite level of the theme; signals only, no cash path.
    """
    w = series(key)
    df = bad_stage_streak(week, key, confirm)
    fresh = (F.col("stage") == "markup") & F.coalesce(F.lag("stage").over(w) != "markup", F.lit(True))
    df = df.withColumn("entry", fresh)
    since = F.last(F.when(F.col("entry"), F.col("level")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("position_return", F.col("level") / since - 1)
    stop = F.coalesce(F.col("position_return") <= hard_stop, F.lit(False))
    return df.withColumn("exit", (F.col("confirmed") | stop) & F.col("position_return").isNotNull())


def theme_leaders(bars: DataFrame, members: DataFrame, keys: DataFrame, n: int = 3, blended: bool = False, p_scores: DataFrame | None = None, w_model: float = 0.4) -> DataFrame:
    """Top n members per (theme, rd): closeness to the yearly high and volume rank inside the theme.

    `keys` has (asset, rd). With `p_scores` (asset, rd, p) the model rank gets the weight `w_model`.
    """
    from panelspark.operators.xsection import percentile_ranks, rank_in_date

    w = series("asset")
    cnt = F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    sd = F.stddev_samp("volume").over(trailing(w, 60))
    feat = bars.select(
        "asset", "d", cnt.alias("n_bars"),
        F.when(cnt >= 252, F.col("close") / F.max("close").over(trailing(w, 252)) - 1).alias("dist"),
        F.when((cnt >= 60) & (sd > 0), (F.col("volume") - F.avg("volume").over(trailing(w, 60))) / sd).otherwise(0.0).alias("vol_z"))
    at = asof(keys, feat, ["asset"], "rd", "d", ["n_bars", "dist", "vol_z"]).filter(F.col("n_bars") >= 60)
    cand = at.join(members, "asset").withColumn("vol_z", F.round("vol_z", 9))
    cols = ["vol_z"]
    if p_scores is not None:
        cand = cand.join(p_scores, ["asset", "rd"], "left")
        cols.append("p")
    r = percentile_ranks(cand, ["rd", "theme"], ["asset"], cols, null_fill=None)
    prox = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 + F.coalesce("dist", F.lit(-0.5))))
    base = 0.7 * prox + 0.3 * F.col("vol_z_rank") if blended else 0.5 * prox + 0.3 * F.col("vol_z_rank") + 0.1
    if p_scores is not None:
        base = (1 - w_model) * base + w_model * F.coalesce("p_rank", F.lit(0.0))
    return rank_in_date(r.withColumn("composite_score", F.round(base, 9)), "composite_score", n, ["theme", "rd"])
