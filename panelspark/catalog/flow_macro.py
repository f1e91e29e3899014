"""Flow, macro, derivatives and regime."""

from pyspark.sql import functions as F

from panelspark.catalog.registry import add_cte, query
from panelspark.functions import rolling as R
from panelspark.operators import flow as FL, macro as M, regime as RG, technical as T
from panelspark.sources.normalize import series_to_daily_wide


def _z(x: str, n: int, need: int, part: str) -> str:
    w = f"({part} ORDER BY d ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({x}) OVER {w} >= {need} AND stddev_samp({x}) OVER {w} > 1e-12 THEN ({x} - avg({x}) OVER {w}) / stddev_samp({x}) OVER {w} END"


_P = "PARTITION BY asset"
_ZS = {f"{k}_net_buy_{n}d_zscore": _z(f"{k}_net", n, max(3, n // 3), _P) for k in ("foreign", "inst") for n in (5, 20, 60)}
_ZS["individual_net_buy_20d_zscore"] = _z("individual_net", 20, 6, _P)
add_cte("fsig", "flow", "SELECT *, 0.6 * coalesce(foreign_net_buy_20d_zscore, 0) + 0.4 * coalesce(inst_net_buy_20d_zscore, 0) AS foreign_inst_combined_zscore_20d FROM (SELECT asset, d, t, " +
        ", ".join(f"{e} AS {c}" for c, e in _ZS.items()) + """,
        sum(CASE WHEN foreign_net > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY asset, fg ORDER BY d) AS foreign_buying_streak_days, sum(CASE WHEN inst_net > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY asset, ig ORDER BY d) AS inst_buying_streak_days
        FROM (SELECT *, sum(CASE WHEN foreign_net > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY asset ORDER BY d) AS fg, sum(CASE WHEN inst_net > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY asset ORDER BY d) AS ig FROM flow))""")
_OUT = " ".join(f"{c}:6" for c in FL.SIGNALS)
query("ticker_flow_signals", f"asset d:d {_OUT}", "fsig", "SELECT * FROM fsig")(lambda s: FL.ticker_flow_signals(s.flow()))
query("rolling_z", "asset d:d z:6", "bars", f"SELECT asset, d, {_z('volume', 60, 20, _P)} AS z FROM bars")(lambda s: R.with_rolling_z(s.bars(), R.series("asset"), {"z": ("volume", 60, 20)}))
query("positive_streak", "asset d:d foreign_buying_streak_days:0 inst_buying_streak_days:0", "fsig", "SELECT * FROM fsig")(lambda s: FL.ticker_flow_signals(s.flow()))
add_cte("msig", "mflow", "SELECT market, d, " + ", ".join(f"CASE WHEN count({x}) OVER (PARTITION BY market ORDER BY d ROWS {n - 1} PRECEDING) >= {k} THEN sum({x}) OVER (PARTITION BY market ORDER BY d ROWS {n - 1} PRECEDING) END AS {o}"
        for x, n, k, o in (("foreign_net", 20, 5, "foreign_net_buy_20d"), ("inst_net", 20, 5, "inst_net_buy_20d"), ("foreign_net", 60, 10, "foreign_cumulative_60d"))) + " FROM mflow")


def market_flow(s, unit=1):
    from panelspark.sources.normalize import pivot_investor_classes

    wide = pivot_investor_classes(s.investor_flow())
    return FL.market_flow_signals(wide.select("market", "d", (F.col("foreign_net") * unit).alias("foreign_net"), (F.col("inst_net") * unit).alias("inst_net")))


_MF = {"market_foreign_net_buy_20d_kospi": ("KOSPI", "foreign_net_buy_20d"), "market_foreign_net_buy_20d_kosdaq": ("KOSDAQ", "foreign_net_buy_20d"), "market_inst_net_buy_20d_kospi": ("KOSPI", "inst_net_buy_20d"),
       "market_inst_net_buy_20d_kosdaq": ("KOSDAQ", "inst_net_buy_20d"), "market_foreign_cumulative_60d": ("KOSPI", "foreign_cumulative_60d")}
query("market_flow_signals", "market d:d foreign_net_buy_20d:0 inst_net_buy_20d:0 foreign_cumulative_60d:0", "msig", "SELECT * FROM msig")(market_flow)
add_cte("mfs", "rds msig", "SELECT rd, " + ", ".join(f"max(CASE WHEN market = '{m}' THEN {c} END) AS {o}" for o, (m, c) in _MF.items()) + """
        FROM (SELECT r.rd, s.* EXCLUDE (d) FROM (SELECT rd, market FROM rds, (VALUES ('KOSPI'), ('KOSDAQ')) v(market)) r ASOF LEFT JOIN msig s ON r.market = s.market AND r.rd >= s.d) GROUP BY 1""")
query("asof_market_flow", "rd:d " + " ".join(f"{c}:0" for c in _MF), "mfs", "SELECT * FROM mfs")(lambda s: FL.asof_market_flow(market_flow(s), s.month_ends().select("rd")))
query("asof_ticker_flow", f"asset rd:d {_OUT}", "keys fsig", "SELECT k.asset, k.rd, f.* EXCLUDE (asset, d, t) FROM keys k ASOF LEFT JOIN fsig f ON k.asset = f.asset AND k.rd >= f.d")(
    lambda s: FL.asof_ticker_flow(FL.ticker_flow_signals(s.flow()), s.keys()))
query("asof_holding_change", "asset rd:d foreign_holding_pct:6 foreign_holding_change_20d:6", "keys flow", """
    SELECT a.asset, a.rd, a.h AS foreign_holding_pct, a.h - b.h AS foreign_holding_change_20d FROM
      (SELECT k.asset, k.rd, f.holding_pct AS h FROM keys k ASOF LEFT JOIN flow f ON k.asset = f.asset AND k.rd >= f.d) a JOIN
      (SELECT k.asset, k.rd, f.holding_pct AS h FROM (SELECT asset, rd, rd - 20 AS t FROM keys) k ASOF LEFT JOIN flow f ON k.asset = f.asset AND k.t >= f.d) b USING (asset, rd)""")(
    lambda s: FL.asof_holding_change(s.flow(), s.keys()))

_RAW = list(M.RENAME)
add_cte("mwide", "macro", "SELECT d, " + ", ".join(f"last_value({n} IGNORE NULLS) OVER (ORDER BY d) AS {n}" for n in _RAW) + """ FROM
        (SELECT CAST(unnest(generate_series(min(obs_date), max(obs_date), INTERVAL 1 DAY)) AS DATE) AS d FROM macro) LEFT JOIN (SELECT obs_date AS d, """ +
        ", ".join(f"max(value) FILTER (series = '{n}') AS {n}" for n in _RAW) + " FROM macro GROUP BY 1) USING (d)")
_ZM = lambda x: _z(x, 60, 15, "")
add_cte("macs", "mwide", "SELECT d, " + ", ".join(f"{r} AS {c}" for r, c in M.RENAME.items()) + f""",
        bok_base_rate / nullif(lag(bok_base_rate, 60) OVER (ORDER BY d), 0) - 1 AS macro_bok_rate_change_60d, ktb_10y_yield - ktb_3y_yield AS macro_ktb_10y_3y_spread, us_10y - us_2y AS macro_us_10y_2y_spread,
        {_ZM('usd_krw')} AS macro_usd_krw_zscore_60d, usd_krw / nullif(lag(usd_krw, 20) OVER (ORDER BY d), 0) - 1 AS macro_usd_krw_change_20d, kr_pmi - 50 AS macro_kr_pmi_diffusion,
        CASE WHEN count(kr_export_yoy) OVER (ORDER BY d ROWS 2 PRECEDING) >= 2 THEN avg(kr_export_yoy) OVER (ORDER BY d ROWS 2 PRECEDING) END AS macro_export_yoy_3m_avg, {_ZM('dxy')} AS macro_dxy_zscore_60d, {_ZM('wti_close')} AS macro_wti_zscore_60d FROM mwide""")


def macro_panel(s):
    return M.macro_signals(series_to_daily_wide(s.macro(), _RAW))


_MCOLS = M.GROUPS["macro"]
query("macro_signals", "d:d " + " ".join(f"{c}:{6 if 'zscore' in c or 'change' in c else 10}" for c in _MCOLS), "macs", "SELECT * FROM macs")(macro_panel)
query("ffill_daily", "d:d usd_krw:9 vix:9", "mwide", "SELECT * FROM mwide")(lambda s: series_to_daily_wide(s.macro(), _RAW))
_LAGGED = ["macro_kr_pmi", "macro_usd_krw", "macro_usd_krw_zscore_60d", "macro_bok_rate_change_60d", "macro_consumer_sentiment", "macro_export_yoy_3m_avg"]
add_cte("macl", "rds macs", "SELECT r.rd, " + ", ".join(f"(SELECT arg_max({c}, d) FROM macs m WHERE m.{c} IS NOT NULL AND m.d + {M.PUBLICATION_LAG.get(c, 0)} <= r.rd) AS {c}" for c in [*_LAGGED, "macro_usd_krw_change_20d"]) + " FROM rds r")
query("macro_snapshot_lagged", "rd:d " + " ".join(f"{c}:{6 if 'zscore' in c or 'change' in c else 9}" for c in _LAGGED), "macl", "SELECT * FROM macl")(lambda s: M.asof_panel_lagged(macro_panel(s), s.month_ends(), _LAGGED))


def derivatives(s):
    oi = s.investor_flow().filter((F.col("market") == "KOSPI") & (F.col("investor") == "pension")).select("d", F.col("net").alias("foreign_futures_net_oi"))
    return M.derivative_signals(T.realized_vol(s.market()).join(oi, "d", "left"))


add_cte("deriv", "vol invflow", f"""
    SELECT d, vkospi_level, {_z('vkospi_level', 60, 10, '')} AS vkospi_zscore_60d, vkospi_level / lag(vkospi_level, 5) OVER (ORDER BY d) - 1 AS vkospi_change_5d, coalesce(vkospi_level > 25, false) AS vkospi_above_25,
      oi AS foreign_futures_net_oi, oi - lag(oi, 5) OVER (ORDER BY d) AS foreign_futures_net_5d_change FROM vol LEFT JOIN (SELECT d, net AS oi FROM invflow WHERE market = 'KOSPI' AND investor = 'pension') USING (d)""")
query("derivative_signals", "d:d vkospi_level:6 vkospi_zscore_60d:6 vkospi_change_5d:6 vkospi_above_25 foreign_futures_net_oi:0 foreign_futures_net_5d_change:0", "deriv", "SELECT * FROM deriv")(derivatives)
query("derivatives_snapshot", "rd:d vkospi_level:6 vkospi_change_5d:6", "rds deriv", "SELECT rd, vkospi_level, vkospi_change_5d FROM rds ASOF LEFT JOIN deriv ON rd >= d")(
    lambda s: M.asof_panel(derivatives(s), s.month_ends(), ["vkospi_level", "vkospi_change_5d"]))
query("vkospi_at", "rd:d vkospi_level:6", "rds deriv", "SELECT rd, coalesce(vkospi_level, 18) AS vkospi_level FROM (SELECT rd - 40 AS rd FROM rds) r ASOF LEFT JOIN deriv ON rd >= d")(
    lambda s: M.vkospi_at(derivatives(s), s.month_ends().select(F.date_sub("rd", 40).alias("rd"))))

UNIT = 100000  # flow amounts brought to the size the regime thresholds expect


def regimes(s):
    rds = s.month_ends().select("rd")
    tech = T.aligned_at(s.bars(), s.keys())
    w = M.day()
    r5 = s.market().select("d", (F.try_divide(F.col("close"), F.lag("close", 5).over(w)) - 1).alias("kospi_5d_return"))
    trend = RG.market_trend_flag(tech, 0.03).join(M.asof_panel(r5, rds, ["kospi_5d_return"]), "rd")
    return RG.regime_snapshots(
        M.asof_panel_lagged(macro_panel(s), rds, [*_LAGGED, "macro_usd_krw_change_20d"]), FL.asof_market_flow(market_flow(s, UNIT), rds),
        M.asof_panel(derivatives(s), rds, ["vkospi_level", "vkospi_zscore_60d"]), trend)


add_cte("regin", "keys tech macl mfs deriv mkt", f"""
    SELECT t.rd, up, coalesce(v.vkospi_level, 18) AS vk, v.vkospi_zscore_60d AS vkz, coalesce(macro_usd_krw, 1300) AS fx, coalesce(macro_usd_krw_zscore_60d, 0) AS fxz, coalesce(macro_bok_rate_change_60d, 0) AS bok, macro_bok_rate_change_60d, macro_usd_krw_change_20d,
      coalesce(macro_kr_pmi, 50) AS pmi, coalesce(market_foreign_cumulative_60d, 0) * {UNIT} AS cum, coalesce(market_foreign_net_buy_20d_kospi, 0) * {UNIT} AS f20, coalesce(r5.r, 0) AS r5
    FROM (SELECT rd, avg(CASE WHEN coalesce(close > ma_20 AND ma_20 > ma_50 AND ma_50 > ma_150 AND ma_150 > ma_200, false) THEN 1.0::DOUBLE ELSE 0 END) > 0.03 AS up FROM keys k ASOF LEFT JOIN tech t ON k.asset = t.asset AND k.rd >= t.d GROUP BY 1) t
    JOIN macl USING (rd) JOIN mfs USING (rd) ASOF LEFT JOIN deriv v ON t.rd >= v.d ASOF LEFT JOIN (SELECT d, close / lag(close, 5) OVER (ORDER BY d) - 1 AS r FROM mkt) r5 ON t.rd >= r5.d""")
add_cte("regime", "regin", """
    SELECT *, CASE WHEN (fx > 1400 OR fxz > 2.5) AND cum < -1e13 AND r5 < -0.1 THEN 'won_crisis' WHEN pmi < 48 AND fxz > 1 AND bok > 0 THEN 'stagflation_kr'
      WHEN NOT up AND vk > 30 AND f20 > -1e12 THEN 'bear_bottoming' WHEN NOT up AND (vk > 25 OR cum < -5e12) THEN 'bear_falling' WHEN up AND cum > 0 AND pmi < 50 THEN 'recovery'
      WHEN up AND vk < 18 AND cum > 5e12 THEN 'bull_trending' WHEN up AND vk > 20 AND f20 < 0 THEN 'bull_peaking' WHEN up AND cum > 0 THEN 'bull_trending' ELSE 'sideways' END AS label FROM regin""")
_MULT = "(VALUES " + ", ".join(f"('{k}', {max(.3, a)}, {max(.3, b)}, {max(.3, c)})" for k, (a, b, c) in RG.MULTIPLIERS.items()) + ") m(label, core, future, early)"
query("classify_regime", "rd:d regime_label_kr core:2 future:2 early:2 kospi_above_ma200 usd_krw_change_20d:7 bok_rate_change_60d:7 foreign_kospi_cumulative_5d:0", "regime", f"""
    SELECT rd, r.label AS regime_label_kr, core, future, early, up AS kospi_above_ma200, macro_usd_krw_change_20d AS usd_krw_change_20d, macro_bok_rate_change_60d AS bok_rate_change_60d, cum AS foreign_kospi_cumulative_5d FROM regime r JOIN {_MULT} USING (label)""")(
    lambda s: regimes(s).withColumnsRenamed({f"regime_sleeve_multiplier_{k}": k for k in ("core", "future", "early")}).fillna(0, ["foreign_kospi_cumulative_5d"]))
query("add_regime", "asset rd:d regime_label_kr", "keys regime", "SELECT asset, k.rd, label AS regime_label_kr FROM keys k JOIN regime USING (rd)")(lambda s: FL.broadcast_snapshot(s.keys(), regimes(s)))
query("regime_distribution", "regime_label_kr n_rows:i n_dates:i", "keys regime", "SELECT label AS regime_label_kr, count(*) AS n_rows, count(DISTINCT k.rd) AS n_dates FROM keys k JOIN regime USING (rd) GROUP BY 1")(
    lambda s: RG.regime_distribution(FL.broadcast_snapshot(s.keys(), regimes(s))))
