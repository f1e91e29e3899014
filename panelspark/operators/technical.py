"""Technical indicators for every asset and every date in one plan.

All windows share the (asset, d) specification, so the whole set costs one
exchange and one sort; each step only adds columns other steps build on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.functions.ewm import add_ewm
from panelspark.functions.rolling import roll_std, rolling_extremes, rolling_moments, running, series, trailing
from panelspark.functions.scalars import clip
from panelspark.operators.asof import asof, newest_at



def _w():
    return series("asset")


SMA_WINDOWS = (5, 20, 50, 60, 150, 200)


def with_row_index(bars: DataFrame) -> DataFrame:
    return bars if "t" in bars.columns else bars.withColumn("t", F.row_number().over(_w()) - 1)


def sma(bars: DataFrame, windows=SMA_WINDOWS) -> DataFrame:
    """Simple averages as differences of one running sum: constant work per row whatever the window."""
    c = F.col("close")
    df = bars.withColumns({"_rs": F.sum(c).over(running(_w())), "_rc": F.count(c).over(running(_w()))})
    z = lambda x, n: F.coalesce(F.lag(x, n).over(_w()), F.lit(0))
    cols = {f"ma_{n}": F.when(F.col("_rc") - z("_rc", n) == n, (F.col("_rs") - z("_rs", n)) / n) for n in windows}
    return df.withColumns(cols).drop("_rs", "_rc")


def _dist(c: str) -> Column:
    return F.when(F.col(c) > 0, F.col("close") / F.col(c) - 1)


def ma_stack_aligned(df: DataFrame) -> DataFrame:
    c = [F.col(x) for x in ("close", "ma_20", "ma_50", "ma_150", "ma_200")]
    ok = (c[0] > c[1]) & (c[1] > c[2]) & (c[2] > c[3]) & (c[3] > c[4])
    return df.withColumn("ma_stack_aligned", F.coalesce(ok, F.lit(False)))


def extremes_52w(df: DataFrame, n: int = 252) -> DataFrame:
    c = F.col("close")
    enough = F.count(c).over(running(_w())) >= 5
    out = rolling_extremes(df, _w(), {"high_52w": ("close", "max"), "low_52w": ("close", "min")}, n)
    out = out.withColumn("_enough", enough).withColumns({x: F.when(F.col("_enough"), F.col(x)) for x in ("high_52w", "low_52w")}).drop("_enough")
    return out.withColumns({
        "dist_from_52w_high": F.when(F.col("high_52w") > 0, c / F.col("high_52w") - 1),
        "dist_from_52w_low": F.when(F.col("low_52w") > 0, c / F.col("low_52w") - 1),
        "new_52w_high_flag": F.coalesce(c >= F.col("high_52w") * 0.999, F.lit(False)),
    })


def volume_stats(df: DataFrame, n: int = 50) -> DataFrame:
    v = F.col("volume")
    out = rolling_moments(df, _w(), {"_v50": ("volume", n, n)}).withColumnsRenamed({"_v50_mean": "volume_ma_50", "_v50_sd": "_vs"})
    out = out.withColumn("_v5", F.avg(v).over(trailing(_w(), 5)))
    m = F.col("volume_ma_50")
    return out.withColumns({
        "volume_zscore_50": F.when(m.isNotNull(), F.when(F.col("_vs") > 0, (v - m) / F.col("_vs")).otherwise(0.0)),
        "volume_dryup_pct": F.when(m > 0, F.col("_v5") / m),
    }).drop("_vs", "_v5")


def wilder(df: DataFrame, rsi_n: int = 14, atr_ns=(14, 20, 60)) -> DataFrame:
    """RSI and average true ranges; both smooth with alpha = 1/n from the first row."""
    pc = F.lag("close").over(_w())
    chg = F.col("close") - pc
    base = with_row_index(df).withColumns({
        "_g": F.coalesce(F.greatest(chg, F.lit(0.0)), F.lit(0.0)),
        "_l": F.when(chg.isNull(), 0.0).otherwise(F.greatest(-chg, F.lit(0.0))),
        "_tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc)),
    })
    means = {"_ag": ("_g", rsi_n), "_al": ("_l", rsi_n), **{f"_atr{n}": ("_tr", n) for n in atr_ns}}
    out = add_ewm(base, "asset", "d", means)
    rsi = F.when((F.col("t") >= rsi_n) & (F.col("_al") > 0), 100 - 100 / (1 + F.col("_ag") / F.col("_al")))
    cols = {"rsi_14": rsi}
    for n in atr_ns:
        a = F.when(F.col("t") >= n, F.col(f"_atr{n}"))
        cols |= {f"atr_{n}": a, f"atr_pct_{n}": F.when(F.col("close") > 0, a / F.col("close"))}
    out = out.withColumns(cols)
    return out.withColumns({
        "rsi_overbought": F.coalesce(F.col("rsi_14") > 70, F.lit(False)),
        "rsi_oversold": F.coalesce(F.col("rsi_14") < 30, F.lit(False)),
    }).drop("_g", "_l", "_tr", *means)


def vol_contraction(df: DataFrame) -> DataFrame:
    return df.withColumn("vol_contraction", F.when(F.col("atr_pct_60") >= 1e-9, F.col("atr_pct_20") / F.col("atr_pct_60")))


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    c = F.col("close")
    out = rolling_moments(df, _w(), {"_b": ("close", n, n)}).withColumnsRenamed({"_b_mean": "_m", "_b_sd": "_s"})
    up, lo = F.col("_m") + k * F.col("_s"), F.col("_m") - k * F.col("_s")
    out = out.withColumns({"bb_upper_20": up, "bb_lower_20": lo})
    width = F.col("bb_upper_20") - F.col("bb_lower_20")
    return out.withColumn("bb_position", clip(F.when(width >= 1e-9, (c - F.col("bb_lower_20")) / width), 0, 1)).drop("_m", "_s")


def weinstein_stage(df: DataFrame) -> DataFrame:
    c, m = F.col("close"), F.col("ma_200")
    out = with_row_index(df).withColumn("_prev", F.lag("ma_200", 20).over(_w()))
    slope = m / F.col("_prev") - 1
    above, below = c > m * 1.02, c < m * 0.98
    label = (
        F.when((F.col("t") < 219) | F.col("_prev").isNull() | (F.col("_prev") < 1e-9), "unknown")
        .when(above & (slope > 0.005), "2_uptrend")
        .when(below & (slope < -0.005), "4_decline")
        .when(above, "3_topping")
        .otherwise("1_basing")
    )
    return out.withColumn("stage_label", label).drop("_prev")


def trend_template(df: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Eight trend conditions counted; the strength condition compares with the index over 251 sessions."""
    c = F.col("close")
    out = with_row_index(df).withColumns({"_prev": F.lag("ma_200", 20).over(_w()), "_own": F.try_divide(c, F.lag(c, 251).over(_w())) - 1})
    if index is not None:
        wi = Window.partitionBy(F.lit(1)).orderBy("d")
        ix = index.select("d", (F.try_divide(F.col("close"), F.lag("close", 251).over(wi)) - 1).alias("_idx"))
        out = out.join(F.broadcast(ix), "d", "left")  # a row a session
    else:
        out = out.withColumn("_idx", F.lit(None).cast("double"))
    m50, m150, m200 = F.col("ma_50"), F.col("ma_150"), F.col("ma_200")
    conds = [
        (c > m150) & (c > m200), m150 > m200, m200 / F.col("_prev") - 1 > 0.005, (m50 > m150) & (m150 > m200), c > m50,
        c >= F.col("low_52w") * 1.25, c >= F.col("high_52w") * 0.75, F.col("_own") > F.col("_idx"),
    ]
    score = sum((F.coalesce(x, F.lit(False)).cast("int") for x in conds), F.lit(0))
    out = out.withColumn("trend_template_score", F.when(F.col("t") >= 219, score).otherwise(0))
    return out.withColumn("trend_template_pass", F.col("trend_template_score") >= 7).drop("_prev", "_own", "_idx")


def breakout_and_distances(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "breakout_flag": F.col("new_52w_high_flag") & (F.coalesce("volume_zscore_50", F.lit(0.0)) > 1.5),
        **{f"dist_from_ma_{n}": _dist(f"ma_{n}") for n in (50, 150, 200)},
    })


def technical_features(bars: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """The whole indicator set on every bar."""
    df = with_row_index(bars)
    # smoothing sorts anew, so it comes first, while rows are narrow
    for step in (wilder, sma, ma_stack_aligned, extremes_52w, volume_stats, vol_contraction, bollinger, weinstein_stage):
        df = step(df)
    df = breakout_and_distances(trend_template(df, index))
    return df.withColumn("atr_pct", F.col("atr_pct_14"))


def technical_at(bars: DataFrame, index: DataFrame | None, keys: DataFrame) -> DataFrame:
    """Indicators as of each (asset, rd), with the group's defaults where an asset has no bars yet."""
    from panelspark.functions.feature_groups import GROUPS, default_of

    cols = GROUPS["technical"]
    newest = newest_at(technical_features(bars, index).select("asset", "d", *cols), keys, ["asset"], "d")
    out = asof(keys, newest, ["asset"], "rd", "d", cols)
    fills = {c: F.coalesce(F.col(c), default_of("technical", c)) for c in cols if c.endswith("flag") or c in ("stage_label", "trend_template_score", "trend_template_pass", "ma_stack_aligned", "rsi_overbought", "rsi_oversold")}
    return out.withColumns(fills)


def aligned_at(bars: DataFrame, keys: DataFrame) -> DataFrame:
    """ma_stack_aligned as of each (asset, rd), from the averages alone; False where an asset has no bars yet."""
    flags = ma_stack_aligned(sma(bars.select("asset", "d", "close"), (20, 50, 150, 200))).select("asset", "d", "ma_stack_aligned")
    out = asof(keys, newest_at(flags, keys, ["asset"], "d"), ["asset"], "rd", "d", ["ma_stack_aligned"])
    return out.withColumn("ma_stack_aligned", F.coalesce("ma_stack_aligned", F.lit(False)))


def realized_vol(index: DataFrame, n: int = 20) -> DataFrame:
    """Annualised volatility of log returns over n sessions (n/2 at least), in points."""
    w = Window.partitionBy(F.lit(1)).orderBy("d")
    r = index.select("d", F.ln(F.col("close") / F.lag("close").over(w)).alias("_r"))
    vol = roll_std(F.col("_r"), w, n, n // 2) * F.sqrt(F.lit(252.0)) * 100
    return r.withColumn("vkospi_level", vol).filter(F.col("vkospi_level").isNotNull()).select("d", "vkospi_level")


def trend_gate(mode: str) -> Column:
    """1.0 or 0.0 from technical flags; missing inputs are neutral."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    if mode == "pre_entry":
        truthy = F.coalesce(F.col("vol_contraction") != 0, F.lit(False)) | flag("rsi_oversold")
        return (truthy & (F.abs(F.coalesce("dist_from_52w_high", F.lit(0.0))) < 0.25)).cast("double")
    if mode == "continuation":
        return ((flag("trend_template_pass") & flag("ma_stack_aligned")) | flag("new_52w_high_flag")).cast("double")
    if mode == "exit":
        active = (F.coalesce("dist_from_ma_50", F.lit(0.0)) < -0.05) & (F.coalesce("volume_zscore_50", F.lit(0.0)) > 2) & ~flag("trend_template_pass")
        return 1.0 - active.cast("double")
    return F.lit(1.0)


def apply_trend_gate(df: DataFrame, score: str, mode: str = "pre_entry", soft: float = 0.5, out: str = "score_trend_gated") -> DataFrame:
    g = trend_gate(mode)
    return df.withColumn(out, F.col(score) * (g + F.lit(soft) * (1.0 - g)))
