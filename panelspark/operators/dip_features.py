"""Forty-two features of a dip. Rows around each dip are looked up by position, so the cost follows the dips and not the bars.

The price and volume columns are also there for every bar, from row frames over one sort per asset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.functions.rolling import before, rolling_extremes, running, series, trailing
from panelspark.operators.around import around
from panelspark.operators.asof import asof
from panelspark.sources.files import materialize

PRICE = ["f_dip_duration_days", "f_pre_dip_uptrend_30d", "f_pre_dip_consolidation_days", "f_dist_from_52w_high", "f_dist_from_50_ma", "f_dist_from_200_ma",
         "f_bollinger_band_position", "f_rsi_14_at_dip", "f_atr_14_pct"]
VOLUME = ["f_vol_dip_day_z60", "f_vol_5d_avg_vs_60d", "f_vol_dryup_pct_pre_dip", "f_obv_slope_30d", "f_ad_slope_30d", "f_vol_post_dip_5d_vs_dip_day",
          "f_intraday_close_position", "f_dip_day_value_zscore_60d"]


def _w():
    return series("asset")


def numbered(bars: DataFrame) -> DataFrame:
    """Bars with their row number t and what the features need of single rows: neighbours, changes and running sums."""
    c, v, prev = F.col("close"), F.col("volume"), F.lag("close").over(_w())
    span = F.col("high") - F.col("low")
    clv = F.when(span > 0, ((c - F.col("low")) - (F.col("high") - c)) / span).otherwise(0.0)
    out = bars.select("asset", "d", "high", "low", "close", "volume", "value", *[x for x in bars.columns if x == "_dip"]).withColumns({
        "t": F.row_number().over(_w()).cast("bigint") - 1, "chg": c - prev, "tr": F.greatest(span, F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)),
        "ov": F.signum(c - prev) * v, "ad": clv * v,
        "run": F.sum(c).over(running(_w())), "vrun": F.sum(v).over(running(_w())),
    })
    out = out.withColumns({"run20": F.lag("run", 20, 0.0).over(_w()), "run61": F.lag("run", 61, 0.0).over(_w()), "vol30": (F.lag("vrun", 1).over(_w()) - F.lag("vrun", 31, 0.0).over(_w())) / 30})
    out = rolling_extremes(out.drop("vrun"), _w(), {"last30": ("close", "max")}, 30)
    return out.withColumn("peak30", F.lag("last30", 1).over(_w())).withColumn("peak31", F.greatest("peak30", "close")).drop("last30")


#: What is read of the rows around a dip, and of the dip's own row alone.
_ROW = ["close", "volume", "value", "chg", "tr", "ov", "ad", "run", "flat", "next", "base"]
_OWN = ["d", "high", "low", "run61", "vol30", "peak30", "peak31", "hi", "m50", "m200"]


def _marked(bars: DataFrame, dips: DataFrame) -> DataFrame:
    """Bars with `_dip`: whether the asset has a dip on that day. The days of an asset travel as one list, so no bar is shuffled for its mark."""
    days = dips.groupBy("asset").agg(F.collect_set("dip_date").alias("_days"))
    return bars.join(days, "asset", "left").withColumn("_dip", F.coalesce(F.array_contains("_days", F.col("d")), F.lit(False))).drop("_days")


def _dip_rows(bars: DataFrame) -> DataFrame:
    """Numbered bars with what long ranges come to: averages from running sums, the highest close from short frames. What only a dip's own row is asked for is kept there alone."""
    w, c = _w(), F.col("close")
    df = numbered(bars).withColumns({"_n": F.count(c).over(running(w)), "next": F.lead(c).over(w), "base": F.lag(c, 29).over(w), "_far": F.lag(c, 252).over(w)})
    at = lambda x, k: F.coalesce(F.lag(x, k).over(w), F.lit(0))
    mean = lambda k: F.try_divide(F.lag("run", 1).over(w) - at("run", k + 1), at("_n", 1) - at("_n", k + 1))
    df = df.withColumns({"m50": mean(50), "m200": mean(200), "flat": F.abs(F.try_divide(c, (F.col("run") - F.col("run20")) / 20) - 1) < 0.03})
    df = rolling_extremes(df, w, {"_hi": ("close", "max")}, 252).withColumn("hi", F.greatest("_hi", "_far"))
    return df.select("asset", "t", "_dip", *_ROW, *[F.when(F.col("_dip"), F.col(x)).alias(x) for x in _OWN])


def bar_features(bars: DataFrame, dips: DataFrame) -> DataFrame:
    """The price and volume columns of each distinct (asset, dip_date) whose date is a bar: (asset, d, t, PRICE, VOLUME)."""
    rows = materialize(_dip_rows(_marked(bars, dips)), "numbered-bars")
    carried = ["asset", "t", "close", "volume", "value", *_OWN]
    near = around(rows.filter("_dip").select(*carried), rows, "asset", "t", -60, 5, _ROW)
    o, x, vol = F.col("o"), F.col("_close"), F.col("_volume")
    frame = lambda lo, hi: o.between(lo, hi)
    within = lambda f, lo, hi, c: f(F.when(frame(lo, hi), c))
    # close to the mean of the last 20 rows, of those from 60 rows before the dip on where there are fewer
    nth = o + 61
    flat = F.when(nth >= 20, F.col("_flat")).otherwise(F.abs(F.try_divide(x, (F.col("_run") - F.col("run61")) / nth) - 1) < 0.03)
    # one row after the latest maximum, and the close 30 rows before that
    top = F.when(frame(-30, -1) & (x == F.col("peak30")), o)
    a = near.groupBy(*carried).agg(
        within(F.avg, -20, -1, x).alias("mu"), within(F.stddev_samp, -20, -1, x).alias("sd"),
        F.min(F.when(frame(-30, 0) & (x == F.col("peak31")), o)).alias("first_peak"), F.max(top).alias("last_peak"), F.max_by("_next", top).alias("at_peak"), F.max_by("_base", top).alias("base"),
        F.count_if(frame(-51, -1) & flat).alias("near"),
        within(F.avg, -13, 0, F.greatest(F.col("_chg"), F.lit(0.0))).alias("gain"), within(F.avg, -13, 0, F.greatest(-F.col("_chg"), F.lit(0.0))).alias("loss"),
        within(F.avg, -13, 0, F.col("_tr")).alias("atr"),
        within(F.avg, -60, -1, vol).alias("v_mu"), within(F.stddev_samp, -60, -1, vol).alias("v_sd"), within(F.avg, -5, -1, vol).alias("v5"), within(F.avg, 1, 5, vol).alias("v_post"),
        F.count_if(frame(-30, -1) & (vol < F.col("vol30") * 0.7)).alias("dry"),
        within(F.avg, -60, -1, F.col("_value")).alias("w_mu"), within(F.stddev_samp, -60, -1, F.col("_value")).alias("w_sd"),
        within(F.sum, -29, 0, F.col("_ov")).alias("ov"), within(F.max, -29, -29, F.col("_ov")).alias("ov0"),
        within(F.sum, -29, 0, F.col("_ad")).alias("ad"), within(F.max, -29, -29, F.col("_ad")).alias("ad0"),
    )
    c, t, v, span = F.col("close"), F.col("t"), F.col("volume"), F.col("high") - F.col("low")
    when = lambda n, value, more=F.lit(True): F.when((t >= n) & more, value)
    slope = lambda k: (F.col(k) - F.col(f"{k}0")) / F.greatest(F.lit(1.0), F.abs(F.col(f"{k}0")) + 1e-9)
    z = lambda value, k: when(60, (value - F.col(f"{k}_mu")) / F.col(f"{k}_sd"), F.col(f"{k}_sd") > 0)
    rise = when(31, F.col("at_peak") / F.col("base") - 1, (t + F.col("last_peak") + 1 > 30) & (F.col("base") > 0))
    rsi = F.when(F.col("loss") > 0, 100 - 100 / (1 + F.col("gain") / F.col("loss"))).otherwise(100.0)
    return a.select(
        "asset", "d", "t",
        when(30, (-F.col("first_peak")).cast("double")).alias("f_dip_duration_days"), rise.alias("f_pre_dip_uptrend_30d"),
        when(60, F.col("near").cast("double")).alias("f_pre_dip_consolidation_days"), when(252, c / F.col("hi") - 1).alias("f_dist_from_52w_high"),
        when(50, c / F.col("m50") - 1).alias("f_dist_from_50_ma"), when(200, c / F.col("m200") - 1).alias("f_dist_from_200_ma"),
        when(20, (c - F.col("mu")) / (2 * F.col("sd")), F.col("sd") > 0).alias("f_bollinger_band_position"), when(15, rsi).alias("f_rsi_14_at_dip"),
        when(15, F.col("atr") / c).alias("f_atr_14_pct"),
        z(v, "v").alias("f_vol_dip_day_z60"), when(60, F.col("v5") / F.col("v_mu"), F.col("v_mu") > 0).alias("f_vol_5d_avg_vs_60d"),
        when(30, F.col("dry") / 30.0, F.col("vol30") > 0).alias("f_vol_dryup_pct_pre_dip"), when(30, slope("ov")).alias("f_obv_slope_30d"),
        when(30, slope("ad"), F.col("ad0") != 0).alias("f_ad_slope_30d"), F.when(v > 0, F.col("v_post") / v).alias("f_vol_post_dip_5d_vs_dip_day"),
        F.when(span > 0, (c - F.col("low")) / span).alias("f_intraday_close_position"), z(F.col("value"), "w").alias("f_dip_day_value_zscore_60d"),
    )


def _when(n: int, value: Column, more: Column | None = None) -> Column:
    return F.when((F.col("t") >= n) & (F.lit(True) if more is None else more), value)


def price_features(bars: DataFrame) -> DataFrame:
    """(asset, d, PRICE) of every bar (the tenth column, the magnitude, is in the episode itself); averages exclude the bar's own row."""
    c, t, w = F.col("close"), F.col("t"), _w()
    df = numbered(bars)
    latest = F.struct("close", "t", F.lead("close").over(w).alias("at_peak"), F.lag("close", 29).over(w).alias("base"))
    df = df.withColumns({"_latest": latest, "_first": F.struct("close", (-t).alias("nt")), "_near20": (F.abs(c / ((F.col("run") - F.col("run20")) / 20) - 1) < 0.03).cast("int")})
    # the 20-row mean of a row, of the rows from 60 rows before the bar on where there are fewer
    short = [F.when(F.abs(F.lag("close", k).over(w) / ((F.lag("run", k).over(w) - F.col("run61")) / (61 - k)) - 1) < 0.03, 1).otherwise(0) for k in range(42, 52)]
    mean = lambda n: (F.lag("run", 1).over(w) - F.lag("run", n + 1, 0.0).over(w)) / n
    last14 = lambda x: F.avg(x).over(trailing(w, 14))
    df = df.withColumns({
        "_peak": F.max("_latest").over(before(w, 30)), "_since": F.max("_first").over(w.rowsBetween(-30, 0)), "_hi": F.max("close").over(w.rowsBetween(-252, 0)), "_m50": mean(50), "_m200": mean(200),
        "_near": F.sum("_near20").over(w.rowsBetween(-41, -1)) + sum(short[1:], short[0]), "_mu": F.avg("close").over(before(w, 20)), "_sd": F.stddev_samp("close").over(before(w, 20)),
        "_gain": last14(F.greatest(F.col("chg"), F.lit(0.0))), "_loss": last14(F.greatest(-F.col("chg"), F.lit(0.0))), "_atr": last14(F.col("tr")),
    })
    rsi = F.when(F.col("_loss") > 0, 100 - 100 / (1 + F.col("_gain") / F.col("_loss"))).otherwise(100.0)
    return df.select(
        "asset", "d", _when(30, (t + F.col("_since.nt")).cast("double")).alias("f_dip_duration_days"),
        _when(31, F.col("_peak.at_peak") / F.col("_peak.base") - 1, (F.col("_peak.t") + 1 > 30) & (F.col("_peak.base") > 0)).alias("f_pre_dip_uptrend_30d"),
        _when(60, F.col("_near").cast("double")).alias("f_pre_dip_consolidation_days"), _when(252, c / F.col("_hi") - 1).alias("f_dist_from_52w_high"),
        _when(50, c / F.col("_m50") - 1).alias("f_dist_from_50_ma"), _when(200, c / F.col("_m200") - 1).alias("f_dist_from_200_ma"),
        _when(20, (c - F.col("_mu")) / (2 * F.col("_sd")), F.col("_sd") > 0).alias("f_bollinger_band_position"), _when(15, rsi).alias("f_rsi_14_at_dip"), _when(15, F.col("_atr") / c).alias("f_atr_14_pct"),
    )


def volume_features(bars: DataFrame) -> DataFrame:
    """(asset, d, VOLUME) of every bar."""
    c, v, w = F.col("close"), F.col("volume"), _w()
    span, month, quarter = F.col("high") - F.col("low"), trailing(w, 30), before(w, 60)
    df = numbered(bars)
    # each of the 30 rows before is held against the bar's own level
    dry = [F.when(F.lag("volume", k).over(w) < F.col("vol30") * 0.7, 1).otherwise(0) for k in range(1, 31)]
    df = df.withColumns({
        "_dry": sum(dry[1:], dry[0]), "_v_mu": F.avg("volume").over(quarter), "_v_sd": F.stddev_samp("volume").over(quarter), "_w_mu": F.avg("value").over(quarter), "_w_sd": F.stddev_samp("value").over(quarter),
        "_v5": F.avg("volume").over(before(w, 5)), "_post": F.avg("volume").over(w.rowsBetween(1, 5)),
        **{f"_{k}": F.sum(k).over(month) for k in ("ov", "ad")}, **{f"_{k}0": F.first(k).over(month) for k in ("ov", "ad")},
    })
    slope = lambda k: (F.col(f"_{k}") - F.col(f"_{k}0")) / F.greatest(F.lit(1.0), F.abs(F.col(f"_{k}0")) + 1e-9)
    z = lambda value, k: _when(60, (value - F.col(f"_{k}_mu")) / F.col(f"_{k}_sd"), F.col(f"_{k}_sd") > 0)
    return df.select(
        "asset", "d", z(v, "v").alias("f_vol_dip_day_z60"), _when(60, F.col("_v5") / F.col("_v_mu"), F.col("_v_mu") > 0).alias("f_vol_5d_avg_vs_60d"),
        _when(30, F.col("_dry") / 30.0, F.col("vol30") > 0).alias("f_vol_dryup_pct_pre_dip"), _when(30, slope("ov")).alias("f_obv_slope_30d"), _when(30, slope("ad"), F.col("_ad0") != 0).alias("f_ad_slope_30d"),
        F.when(v > 0, F.col("_post") / v).alias("f_vol_post_dip_5d_vs_dip_day"), F.when(span > 0, (c - F.col("low")) / span).alias("f_intraday_close_position"), z(F.col("value"), "w").alias("f_dip_day_value_zscore_60d"),
    )


def flow_features(eps: DataFrame, flow: DataFrame) -> DataFrame:
    """Flow around each dip; eps has (asset, dip_date, market_cap_at_dip), flow one row per (asset, d). Positions are days."""
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date")).cast("bigint")
    kinds = ("foreign", "inst", "individual")
    rows = flow.select("asset", day(F.col("d")).alias("n"), *[F.coalesce(f"{k}_net", F.lit(0.0)).alias(k) for k in kinds], F.col("holding_pct").alias("held"))
    keys = eps.select("asset", "dip_date", day(F.col("dip_date")).alias("n")).distinct()
    near = around(keys, rows, "asset", "n", -120, 10, [*kinds, "held"])
    o = F.col("o")
    pre, post = o <= 0, o >= 1
    has = pre & F.col("_held").isNotNull()
    aggs = [F.count_if(pre).alias("n_pre"), F.max_by("_held", F.when(has, o)).alias("held_last"), F.min_by("_held", F.when(has, o)).alias("held_first"),
            F.sum(F.when(o.between(-45, 0), F.col("_foreign"))).alias("f45")]
    for k in kinds:
        x = F.when(pre, F.col(f"_{k}"))
        aggs += [F.avg(x).alias(f"{k}_mu"), F.stddev_samp(x).alias(f"{k}_sd"), F.max(F.when(o == 0, F.col(f"_{k}"))).alias(f"{k}_day")]
    for k in kinds[:2]:
        aggs += [F.sum(F.when(post, F.col(f"_{k}"))).alias(f"{k}_post"), F.array_sort(F.collect_list(F.when(post, F.struct("o", F.col(f"_{k}").alias("x"))))).alias(f"{k}_list")]
    a = near.groupBy("asset", "dip_date").agg(*aggs)
    j = eps.join(a, ["asset", "dip_date"], "left")
    enough = F.col("n_pre") >= 20
    m = F.col("market_cap_at_dip")
    share = lambda c: F.when(m > 0, F.col(c) / m)
    j = j.withColumns({f"f_{k}_net_dip_day_z": F.when(enough & (F.col(f"{k}_sd") > 0), (F.col(f"{k}_day") - F.col(f"{k}_mu")) / F.col(f"{k}_sd")) for k in kinds})
    j = j.withColumn("f_foreign_holding_change_30d_pct", F.when(enough, F.col("held_last") - F.col("held_first")))

    def streak(k: str) -> Column:
        """Rows after the dip before the first that is not positive."""
        stops = F.transform(F.coalesce(f"{k}_list", F.array()), lambda r: r["x"] <= 0)
        return F.coalesce(F.nullif(F.array_position(stops, F.lit(True)), F.lit(0).cast("bigint")) - 1, F.size(stops)).cast("double")

    j = j.withColumns({"f_foreign_buying_streak_post_dip": streak("foreign"), "f_inst_buying_streak_post_dip": streak("inst"), "f_foreign_net_5d_post_dip_pct_mcap": share("foreign_post"),
                       "f_inst_net_5d_post_dip_pct_mcap": share("inst_post"), "f_foreign_net_30d_pct_mcap": share("f45")})
    both = F.coalesce("f_foreign_net_5d_post_dip_pct_mcap", F.lit(0.0)) + F.coalesce("f_inst_net_5d_post_dip_pct_mcap", F.lit(0.0))
    j = j.withColumn("f_smart_money_directional_score", F.greatest(F.lit(-10.0), F.least(F.lit(10.0), both * 100)))
    return j.drop(*[c for c in a.columns if c not in ("asset", "dip_date")])


def context_features(eps: DataFrame, index: DataFrame, vol: DataFrame, risk: DataFrame | None = None) -> DataFrame:
    """Index drawdown and trend, volatility level and change, calendar proximity, governance risk (asset, rd, score)."""
    w = Window.partitionBy(F.lit(1)).orderBy("d")
    cnt = F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    g = F.lit(1).alias("_g")
    ix = index.select("d", g, F.when(cnt >= 252, F.col("close") / F.max(F.col("close")).over(trailing(w, 252)) - 1).alias("f_kospi_drawdown_at_dip"),
                      F.when(cnt >= 200, (F.col("close") > F.avg(F.col("close")).over(trailing(w, 200))).cast("double")).alias("f_kospi_above_ma200"))
    v, v5 = F.col("vkospi_level"), F.lag("vkospi_level", 4).over(w)
    vx = vol.select("d", g, F.when(cnt >= 5, v).alias("f_vkospi_at_dip"), F.when((cnt >= 5) & (v5 > 0), v / v5 - 1).alias("f_vkospi_change_5d"))
    days = eps.select("dip_date").distinct().select("dip_date", g)
    days = asof(days, ix, ["_g"], "dip_date", "d", ["f_kospi_drawdown_at_dip", "f_kospi_above_ma200"])
    days = asof(days, vx, ["_g"], "dip_date", "d", ["f_vkospi_at_dip", "f_vkospi_change_5d"]).drop("_g")
    y = F.year("dip_date")
    q = F.least(*[F.abs(F.datediff("dip_date", F.make_date(y, F.lit(m), F.lit(1)))) for m in (3, 6, 9, 12)])
    out = eps.join(days, "dip_date", "left").withColumns({
        "f_quarter_end_proximity": F.exp(-q / 30.0),
        "f_year_end_proximity": F.exp(-F.abs(F.datediff("dip_date", F.make_date(y, F.lit(12), F.lit(31)))) / 60.0),
        "f_pre_earnings_window": F.lit(0.0),
    })
    if risk is None:
        return out.withColumn("f_governance_risk_score", F.lit(0.0))
    out = asof(out, risk.select("asset", "rd", F.col("governance_risk_score").alias("f_governance_risk_score")), ["asset"], "dip_date", "rd", ["f_governance_risk_score"])
    return out.fillna(0.0, ["f_governance_risk_score"])


# Event categories that count against, for, and as dilution.
NEGATIVE = ["capital_increase", "treasury_sell", "convertible_bond", "warrant_bond", "spinoff", "capital_reduction"]
POSITIVE = ["treasury_buyback", "bonus_issue"]
DILUTIVE = ["capital_increase", "convertible_bond", "warrant_bond"]


def event_features(eps: DataFrame, events: DataFrame) -> DataFrame:
    """Event counts in the days before each dip: running daily counts and three as-of look-ups in one pass."""
    cat = F.col("event_category")
    daily = events.filter(F.col("rcept_dt").isNotNull()).groupBy("asset", F.col("rcept_dt").alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(cat.isin(NEGATIVE)).alias("neg"), F.count_if(cat.isin(POSITIVE)).alias("pos"), F.count_if(cat.isin(DILUTIVE)).alias("dil"))
    w = _w().rowsBetween(Window.unboundedPreceding, 0)
    ms = ["n", "neg", "pos", "dil"]
    tot = daily.select("asset", "d", *[F.sum(m).over(w).alias(m) for m in ms])
    offs = [1, 6, 11, 31]
    tgt = eps.select("asset", "dip_date", F.explode(F.array(*[F.lit(o) for o in offs])).alias("_o")).withColumn("_t0", F.date_sub("dip_date", F.col("_o")))
    got = asof(tgt, tot, ["asset"], "_t0", "d", ms)
    at = lambda o, m: F.coalesce(F.max(F.when(F.col("_o") == o, F.col(m))), F.lit(0))
    agg = got.groupBy("asset", "dip_date").agg(
        (at(1, "n") - at(6, "n")).cast("double").alias("f_dart_event_within_5d_pre_dip"), (at(1, "neg") - at(11, "neg")).cast("double").alias("f_negative_event_within_10d"),
        (at(1, "pos") - at(11, "pos")).cast("double").alias("f_positive_event_within_10d"), (at(1, "dil") - at(31, "dil")).cast("double").alias("f_dilution_event_within_30d"))
    out = eps.join(agg, ["asset", "dip_date"], "left")
    return out.withColumns({"f_dart_event_severity_score": F.col("f_negative_event_within_10d") - 0.5 * F.col("f_positive_event_within_10d"), "f_overheating_flag_within_5d": F.lit(0.0)})


def dip_feature_panel(eps: DataFrame, bars: DataFrame, flow: DataFrame, index: DataFrame, vol: DataFrame, events: DataFrame, risk: DataFrame | None = None) -> DataFrame:
    """All 42 columns for the episodes whose date is a bar of the asset."""
    eps = materialize(eps, "episodes")
    base = bar_features(bars, eps)
    out = eps.join(base.select("asset", F.col("d").alias("dip_date"), *PRICE, *VOLUME), ["asset", "dip_date"])
    out = out.withColumn("f_dip_magnitude_pct", F.when(F.col("peak_close") > 0, F.col("dip_low_close") / F.col("peak_close") - 1))
    out = materialize(context_features(flow_features(out, flow), index, vol, risk), "dip-features")
    return event_features(out, events)
