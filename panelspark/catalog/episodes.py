"""Episodes, labels, splits, dip features and strategy comparison."""

from pyspark.sql import functions as F

from panelspark.catalog.fundamental_events import E as EV, event_universe
from panelspark.catalog.registry import add_cte, query
from panelspark.operators import dip_features as D, episodes as EP, labels as LB, technical as T

TH, BR = 0.12, 0.05  # the fixture's prices move inside a narrow band
add_cte("mb", "mclose", f"""
    SELECT asset, rd AS entry_date, close AS entry_price, dl[p] AS peak_date, cl[p] AS peak_price, cl[p] / close - 1 AS max_return, p AS months_to_peak, t, t + p AS tp FROM (
      SELECT *, list_position(cl, list_max(cl)) AS p FROM (SELECT asset, rd, close, row_number() OVER (PARTITION BY asset ORDER BY rd) AS t, count(*) OVER (PARTITION BY asset) AS n,
        list(close) OVER w AS cl, list(rd) OVER w AS dl FROM mclose WHERE close IS NOT NULL WINDOW w AS (PARTITION BY asset ORDER BY rd ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING)) WHERE n >= 25 AND len(cl) > 0) WHERE cl[p] / close - 1 >= {TH}""")
add_cte("mbk", "mb", """
    SELECT asset, min(t) AS t FROM mb GROUP BY 1 UNION ALL
    SELECT asset, t FROM (SELECT c.asset, min(c.t) AS t FROM mbk k JOIN mb p ON p.asset = k.asset AND p.t = k.t JOIN mb c ON c.asset = k.asset AND c.t > p.tp GROUP BY c.asset)""")
add_cte("eps", "mb mbk mclose mcap", f"""
    SELECT *, datediff('day', entry_date, surge_start_date) / 30.4375::DOUBLE AS accumulation_months, coalesce(mcap_at_entry >= 1e12, false) AS quality_pass FROM (
      SELECT m.* EXCLUDE (t, tp), coalesce((SELECT min(rd) FROM mclose c WHERE c.asset = m.asset AND rd > entry_date AND rd <= peak_date AND close >= entry_price * (1 + {BR}::DOUBLE)),
        (SELECT min(rd) FROM mclose c WHERE c.asset = m.asset AND rd > entry_date AND rd <= peak_date AND close >= entry_price * (1 + {BR / 2}::DOUBLE))) AS surge_start_date, q.market_cap AS mcap_at_entry
      FROM mb m JOIN mbk k ON k.asset = m.asset AND k.t = m.t LEFT JOIN mcap q ON q.asset = m.asset AND q.snapshot_date = m.entry_date)""")


def episodes(s):
    return EP.quality_filter(EP.surge_start(EP.multibagger_episodes(s.month_closes(), TH), s.month_closes(), BR), s.mcap(), 1e12)


query("month_end_prices", "asset rd:d close:2", "mclose", "SELECT * FROM mclose")(lambda s: s.month_closes())
query("multibagger_candidates", "asset entry_date:d peak_date:d max_return:8 months_to_peak:i", "mb", "SELECT * FROM mb")(lambda s: EP.multibagger_candidates(s.month_closes(), TH))
query("multibagger_episodes", "asset entry_date:d entry_price:2 peak_date:d peak_price:2 max_return:8 months_to_peak:i", "eps", "SELECT * FROM eps")(lambda s: EP.multibagger_episodes(s.month_closes(), TH))
query("surge_start", "asset entry_date:d surge_start_date:d accumulation_months:8", "eps", "SELECT * FROM eps")(lambda s: EP.surge_start(EP.multibagger_episodes(s.month_closes(), TH), s.month_closes(), BR))
query("episode_panel", "asset entry_date:d peak_date:d max_return:8 surge_start_date:d mcap_at_entry:0 quality_pass", "eps", "SELECT * FROM eps")(episodes)
query("episode_stats", "n:i assets:i quality:i quality_assets:i return_max:8 p25:8 p50:8 p75:8 p95:8 median_months:4 mcap_median:2 mcap_p95:2", "eps", """
    SELECT count(*) AS n, count(DISTINCT asset) AS assets, count(*) FILTER (quality_pass) AS quality, count(DISTINCT asset) FILTER (quality_pass) AS quality_assets, max(max_return) FILTER (quality_pass) AS return_max,
      quantile_cont(max_return, 0.25) FILTER (quality_pass) AS p25, quantile_cont(max_return, 0.5) FILTER (quality_pass) AS p50, quantile_cont(max_return, 0.75) FILTER (quality_pass) AS p75, quantile_cont(max_return, 0.95) FILTER (quality_pass) AS p95,
      quantile_cont(months_to_peak::DOUBLE, 0.5) FILTER (quality_pass) AS median_months, quantile_cont(mcap_at_entry, 0.5) FILTER (quality_pass) AS mcap_median, quantile_cont(mcap_at_entry, 0.95) FILTER (quality_pass) AS mcap_p95 FROM eps""")(lambda s: EP.episode_stats(episodes(s)))
query("cohort_crosstab", "entry_year:i peak_year:i n:i", "eps", "SELECT year(entry_date) AS entry_year, year(peak_date) AS peak_year, count(*) AS n FROM eps GROUP BY 1, 2")(
    lambda s: EP.cohort_crosstab(episodes(s)))
query("episodes_by_year", "entry_year:i n:i", "eps", "SELECT year(entry_date) AS entry_year, count(*) AS n FROM eps WHERE quality_pass GROUP BY 1")(lambda s: EP.episodes_by_year(episodes(s)))
query("top_episodes", "asset entry_date:d peak_date:d max_return:8", "eps", "SELECT * FROM eps ORDER BY max_return DESC, asset || CAST(entry_date AS VARCHAR) LIMIT 30")(lambda s: EP.top_episodes(episodes(s)))

_LBL = lambda lo, hi, op: f"CASE WHEN EXISTS (SELECT 1 FROM eps e WHERE e.asset = k.asset AND k.rd >= CAST(surge_start_date + INTERVAL ({lo}) MONTH AS DATE) AND k.rd {op} CAST(surge_start_date + INTERVAL ({hi}) MONTH AS DATE)) THEN 1 ELSE 0 END"
add_cte("lab", "keys eps", f"SELECT k.asset, k.rd, {_LBL(-6, 3, '<=')} AS is_pre_surge, {_LBL(-6, -1, '<')} AS is_pre_entry, {_LBL(0, 3, '<=')} AS is_continuation FROM keys k")
query("label_windows", "asset rd:d is_pre_surge:i is_pre_entry:i is_continuation:i", "lab", "SELECT * FROM lab")(lambda s: LB.label_windows(s.keys(), episodes(s)))
for _n, _c in [("label_pre_surge", "is_pre_surge"), ("label_pre_entry", "is_pre_entry"), ("label_continuation", "is_continuation")]:
    query(_n, f"asset rd:d {_c}:i", "lab", "SELECT * FROM lab")(lambda s, _c=_c: LB.label_by_window(s.keys(), episodes(s), _c, *LB.WINDOWS[_c[3:]]))
add_cte("fwd", "mclose", """
    SELECT asset, rd, close, CASE WHEN e IS NOT NULL THEN e / close - 1 END AS forward_return, CASE WHEN e IS NOT NULL THEN m / close - 1 END AS forward_min_return FROM (
      SELECT *, lead(close, 3) OVER (PARTITION BY asset ORDER BY rd) AS e, min(close) OVER (PARTITION BY asset ORDER BY rd ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS m FROM mclose)""")
query("forward_returns", "asset rd:d forward_return:8 forward_min_return:8", "fwd", "SELECT * FROM fwd")(lambda s: LB.forward_returns(s.month_closes()))
query("label_risk", "asset rd:d is_risk:i", "fwd", "SELECT asset, rd, CASE WHEN forward_min_return <= -0.1 THEN 1 ELSE 0 END AS is_risk FROM fwd")(lambda s: LB.label_risk(LB.forward_returns(s.month_closes()), -0.10))
query("label_balance", "label positives:i negatives:i prevalence:8", "lab", " UNION ALL ".join(
    f"SELECT '{c}' AS label, count(*) FILTER ({c} = 1) AS positives, count(*) FILTER ({c} = 0) AS negatives, avg({c}) AS prevalence FROM lab" for c in ("is_pre_surge", "is_pre_entry", "is_continuation")))(
    lambda s: LB.label_balance(LB.label_windows(s.keys(), episodes(s)), ["is_pre_surge", "is_pre_entry", "is_continuation"]))


def _folds(emb: int, table: str = "keys", n_min: int | None = None) -> str:
    return f"""SELECT fold, role, rd, n_train, n_test, n_train > 100 AND n_test > 10 AS usable FROM (SELECT f.*, sum(CASE WHEN role = 'train' THEN c ELSE 0 END) OVER (PARTITION BY fold) AS n_train, sum(CASE WHEN role = 'test' THEN c ELSE 0 END) OVER (PARTITION BY fold) AS n_test FROM (
      SELECT fold, rd, c, CASE WHEN p < (fold + 1) * (n // 6) - {emb} THEN 'train' WHEN p >= (fold + 1) * (n // 6) AND p < (fold + 2) * (n // 6) THEN 'test' END AS role
      FROM (SELECT rd, count(*) AS c, row_number() OVER (ORDER BY rd) - 1 AS p, count(*) OVER () AS n FROM {table} GROUP BY rd), range(0, 5) g(fold)) f WHERE role IS NOT NULL)"""


query("walk_forward_splits", "fold:i role rd:d n_train:i n_test:i usable:b", "keys", _folds(0))(lambda s: LB.walk_forward_splits(s.keys()))
query("purged_splits", "fold:i role rd:d n_train:i n_test:i usable:b", "keys", _folds(9))(lambda s: LB.purged_splits(s.keys()))
query("purged_splits_by_date", "fold:i role rd:d n_train:i n_test:i usable:b", "disc", _folds(60, "(SELECT rcept_dt AS rd FROM disc)"))(
    lambda s: LB.purged_splits(s.disclosures().select(F.col("rcept_dt").alias("rd")), 5, 60))

# dips ------------------------------------------------------------------------------------------
add_cte("dipc", "bars mcap", """
    SELECT c.*, m.market_cap, coalesce(m.market_cap >= 5e11, false) AS ok FROM (
      SELECT asset, t, d AS dip_date, close AS dip_low_close, pk AS peak_close, pd AS peak_date, close / pk - 1 AS drawdown_pct, f[len(f)] AS recovery_close, CASE WHEN up IS NOT NULL AND (dn IS NULL OR up <= dn) THEN 1 WHEN dn IS NOT NULL THEN 0 END AS label,
        CASE WHEN up IS NOT NULL AND (dn IS NULL OR up <= dn) THEN up ELSE dn END AS days FROM (
        SELECT *, nullif(list_position(list_transform(f, lambda x: x >= pk * 0.95::DOUBLE), true), 0) AS up, nullif(list_position(list_transform(f, lambda x: x <= close * 0.8::DOUBLE), true), 0) AS dn FROM (
          SELECT *, list_max(l) AS pk, dl[list_position(l, list_max(l))] AS pd FROM (
            SELECT *, count(*) OVER (PARTITION BY asset) AS n, lag(close) OVER w AS pc, max(close) OVER (PARTITION BY asset ORDER BY d ROWS 4 PRECEDING) AS hi5, list(close) OVER (PARTITION BY asset ORDER BY d ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS l,
              list(d) OVER (PARTITION BY asset ORDER BY d ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS dl, list(close) OVER (PARTITION BY asset ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING) AS f FROM bars WINDOW w AS (PARTITION BY asset ORDER BY d))
          WHERE n >= 95 AND t >= 30 AND t < n - 1 AND (close / pc - 1 <= -0.05 OR close / hi5 - 1 <= -0.1)))) c ASOF LEFT JOIN mcap m ON m.asset = c.asset AND c.dip_date >= m.snapshot_date""")
add_cte("dipk", "dipc", """
    SELECT c.asset, c.t, c.t + CASE WHEN ok THEN greatest(15, coalesce(days, 60)) ELSE 5 END AS until FROM dipc c JOIN (SELECT asset, min(t) AS t FROM dipc GROUP BY 1) f ON f.asset = c.asset AND f.t = c.t UNION ALL
    SELECT c.asset, c.t, c.t + CASE WHEN ok THEN greatest(15, coalesce(days, 60)) ELSE 5 END FROM (SELECT k.asset, min(c.t) AS t FROM dipk k JOIN dipc c ON c.asset = k.asset AND c.t > k.until GROUP BY k.asset) n JOIN dipc c ON c.asset = n.asset AND c.t = n.t""")
add_cte("dips", "dipc dipk", "SELECT c.* FROM dipc c JOIN dipk k ON k.asset = c.asset AND k.t = c.t WHERE ok")


def dips(s):
    return EP.dip_episodes(s.bars(), s.mcap())


query("dip_candidates", "asset dip_date:d peak_date:d peak_close:2 drawdown_pct:8 recovery_close:2 label:0 days_to_label:0", "dipc", "SELECT *, days AS days_to_label FROM dipc")(lambda s: EP.dip_candidates(s.bars()))
query("dip_episodes", "asset dip_date:d peak_date:d dip_low_close:2 peak_close:2 drawdown_pct:8 recovery_close:2 label:0 days_to_label:0 market_cap_at_dip:0", "dips", "SELECT *, days AS days_to_label, market_cap AS market_cap_at_dip FROM dips")(dips)

add_cte("dpf", "bars", """
    SELECT asset, d, CASE WHEN t >= 30 THEN 31 - list_position(l31, list_max(l31)) END AS f_dip_duration_days, CASE WHEN t >= 31 AND t - k > 30 THEN c62[len(c62) - k] / c62[len(c62) - k - 30] - 1 END AS f_pre_dip_uptrend_30d,
      CASE WHEN t >= 60 THEN len(list_filter(range(10, 61), lambda i: abs(past[i] / list_avg(past[greatest(1, i - 19):i]) - 1) < 0.03)) END AS f_pre_dip_consolidation_days,
      CASE WHEN t >= 252 THEN close / hi - 1 END AS f_dist_from_52w_high, CASE WHEN t >= 50 THEN close / m50 - 1 END AS f_dist_from_50_ma, CASE WHEN t >= 200 THEN close / m200 - 1 END AS f_dist_from_200_ma,
      CASE WHEN t >= 20 AND sd > 0 THEN (close - mu) / (2 * sd) END AS f_bollinger_band_position, CASE WHEN t >= 15 THEN CASE WHEN l > 0 THEN 100 - 100 / (1 + g / l) ELSE 100 END END AS f_rsi_14_at_dip, CASE WHEN t >= 15 THEN atr / close END AS f_atr_14_pct FROM (
      SELECT *, list_position(list_reverse(l30), list_max(l30)) - 1 AS k, avg(greatest(close - pc, 0)) OVER w14 AS g, avg(greatest(pc - close, 0)) OVER w14 AS l, avg(CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END) OVER w14 AS atr FROM (
        SELECT *, lag(close) OVER (PARTITION BY asset ORDER BY d) AS pc, max(close) OVER (PARTITION BY asset ORDER BY d ROWS 252 PRECEDING) AS hi, avg(close) OVER (PARTITION BY asset ORDER BY d ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS m50,
          avg(close) OVER (PARTITION BY asset ORDER BY d ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING) AS m200, avg(close) OVER w20 AS mu, stddev_samp(close) OVER w20 AS sd, list(close) OVER (PARTITION BY asset ORDER BY d ROWS 30 PRECEDING) AS l31,
          list(close) OVER (PARTITION BY asset ORDER BY d ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS l30, list(close) OVER (PARTITION BY asset ORDER BY d ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS past, list(close) OVER (PARTITION BY asset ORDER BY d ROWS 61 PRECEDING) AS c62
        FROM bars WINDOW w20 AS (PARTITION BY asset ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) WINDOW w14 AS (PARTITION BY asset ORDER BY d ROWS 13 PRECEDING))""")
_PF = "f_dip_duration_days:0 f_pre_dip_uptrend_30d:7 f_pre_dip_consolidation_days:0 f_dist_from_52w_high:7 f_dist_from_50_ma:7 f_dist_from_200_ma:7 f_bollinger_band_position:6 f_rsi_14_at_dip:6 f_atr_14_pct:7"
query("dip_price_features", f"asset d:d {_PF}", "dpf", "SELECT * FROM dpf")(lambda s: D.price_features(s.bars()))
_Z60 = lambda c: f"CASE WHEN t >= 60 AND stddev_samp({c}) OVER p60 > 0 THEN ({c} - avg({c}) OVER p60) / stddev_samp({c}) OVER p60 END"
add_cte("dvf", "bars", f"""
    SELECT *, CASE WHEN t >= 30 THEN (sum(ov) OVER w30 - first_value(ov) OVER w30) / greatest(1, abs(first_value(ov) OVER w30) + 1e-9) END AS f_obv_slope_30d, CASE WHEN t >= 30 AND first_value(ad) OVER w30 <> 0 THEN (sum(ad) OVER w30 - first_value(ad) OVER w30) / greatest(1, abs(first_value(ad) OVER w30) + 1e-9) END AS f_ad_slope_30d FROM (
      SELECT asset, d, t, {_Z60('volume')} AS f_vol_dip_day_z60, {_Z60('value')} AS f_dip_day_value_zscore_60d, CASE WHEN t >= 60 THEN avg(volume) OVER (PARTITION BY asset ORDER BY d ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) / avg(volume) OVER p60 END AS f_vol_5d_avg_vs_60d,
        CASE WHEN t >= 30 THEN len(list_filter(list(volume) OVER p30, lambda x: x < list_avg(list(volume) OVER p30) * 0.7::DOUBLE)) / 30.0 END AS f_vol_dryup_pct_pre_dip, avg(volume) OVER (PARTITION BY asset ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) / volume AS f_vol_post_dip_5d_vs_dip_day,
        CASE WHEN high > low THEN (close - low) / (high - low) END AS f_intraday_close_position, sign(close - lag(close) OVER w) * volume AS ov, CASE WHEN high > low THEN ((close - low) - (high - close)) / (high - low) ELSE 0 END * volume AS ad
      FROM bars WINDOW w AS (PARTITION BY asset ORDER BY d), p60 AS (PARTITION BY asset ORDER BY d ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), p30 AS (PARTITION BY asset ORDER BY d ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)) WINDOW w30 AS (PARTITION BY asset ORDER BY d ROWS 29 PRECEDING)""".replace(
    "len(list_filter(list(volume) OVER p30, lambda x: x < list_avg(list(volume) OVER p30) * 0.7::DOUBLE)) / 30.0", "dry / 30.0").replace("FROM bars WINDOW w AS", """FROM (SELECT *, len(list_filter(v30, lambda x: x < list_avg(v30) * 0.7::DOUBLE)) AS dry FROM
        (SELECT *, list(volume) OVER (PARTITION BY asset ORDER BY d ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS v30 FROM bars)) WINDOW w AS""").replace(", p30 AS (PARTITION BY asset ORDER BY d ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))", ")"))
_VF = "f_vol_dip_day_z60:6 f_vol_5d_avg_vs_60d:7 f_vol_dryup_pct_pre_dip:6 f_obv_slope_30d:4 f_ad_slope_30d:4 f_vol_post_dip_5d_vs_dip_day:7 f_intraday_close_position:7 f_dip_day_value_zscore_60d:6"
query("dip_volume_features", f"asset d:d {_VF}", "dvf", "SELECT * FROM dvf")(lambda s: D.volume_features(s.bars()))
_FZ = lambda k: f"CASE WHEN count(*) OVER pre >= 20 AND stddev_samp({k}_net) OVER pre > 0 THEN ({k}_net - avg({k}_net) OVER pre) / stddev_samp({k}_net) OVER pre END AS f_{k}_net_dip_day_z"
_STK = lambda l: f"coalesce(nullif(list_position(list_transform({l}, lambda x: x <= 0), true), 0) - 1, len({l}), 0)"
add_cte("dff", "dips flow", f"""
    SELECT e.asset, e.dip_date, f.* EXCLUDE (asset, d, fp, ip, f45, fl, il), fp / market_cap AS f_foreign_net_5d_post_dip_pct_mcap, ip / market_cap AS f_inst_net_5d_post_dip_pct_mcap, f45 / market_cap AS f_foreign_net_30d_pct_mcap,
      greatest(-10, least(10, (coalesce(fp / market_cap, 0) + coalesce(ip / market_cap, 0)) * 100)) AS f_smart_money_directional_score, {_STK('fl')} AS f_foreign_buying_streak_post_dip, {_STK('il')} AS f_inst_buying_streak_post_dip
    FROM dips e LEFT JOIN (SELECT asset, d, {_FZ('foreign')}, {_FZ('inst')}, {_FZ('individual')}, CASE WHEN count(*) OVER pre >= 20 THEN holding_pct - first_value(holding_pct) OVER pre END AS f_foreign_holding_change_30d_pct, sum(foreign_net) OVER post AS fp, sum(inst_net) OVER post AS ip,
        sum(foreign_net) OVER m45 AS f45, list(foreign_net) OVER post AS fl, list(inst_net) OVER post AS il FROM flow
      WINDOW pre AS (PARTITION BY asset ORDER BY d RANGE BETWEEN INTERVAL 120 DAY PRECEDING AND CURRENT ROW), post AS (PARTITION BY asset ORDER BY d RANGE BETWEEN INTERVAL 1 DAY FOLLOWING AND INTERVAL 10 DAY FOLLOWING),
        m45 AS (PARTITION BY asset ORDER BY d RANGE BETWEEN INTERVAL 45 DAY PRECEDING AND CURRENT ROW)) f ON f.asset = e.asset AND f.d = e.dip_date""")
_FF = "f_foreign_net_dip_day_z:6 f_inst_net_dip_day_z:6 f_individual_net_dip_day_z:6 f_foreign_holding_change_30d_pct:6 f_foreign_buying_streak_post_dip:0 f_inst_buying_streak_post_dip:0 f_foreign_net_5d_post_dip_pct_mcap:10 f_inst_net_5d_post_dip_pct_mcap:10 f_foreign_net_30d_pct_mcap:10 f_smart_money_directional_score:8"
query("dip_flow_features", f"asset dip_date:d {_FF}", "dff", "SELECT * FROM dff")(lambda s: D.flow_features(dips(s), s.flow()))
add_cte("dcf", "dips mkt vol gov", """
    SELECT e.asset, e.dip_date, f_kospi_drawdown_at_dip, f_kospi_above_ma200, f_vkospi_at_dip, f_vkospi_change_5d, exp(-least(abs(datediff('day', make_date(year(e.dip_date), 3, 1), e.dip_date)), abs(datediff('day', make_date(year(e.dip_date), 6, 1), e.dip_date)),
        abs(datediff('day', make_date(year(e.dip_date), 9, 1), e.dip_date)), abs(datediff('day', make_date(year(e.dip_date), 12, 1), e.dip_date))) / 30.0::DOUBLE) AS f_quarter_end_proximity,
      exp(-abs(datediff('day', make_date(year(e.dip_date), 12, 31), e.dip_date)) / 60.0::DOUBLE) AS f_year_end_proximity, coalesce(g.governance_risk_score, 0) AS f_governance_risk_score
    FROM dips e ASOF LEFT JOIN (SELECT d, CASE WHEN t >= 251 THEN close / max(close) OVER (ORDER BY d ROWS 251 PRECEDING) - 1 END AS f_kospi_drawdown_at_dip, CASE WHEN t >= 199 THEN CASE WHEN close > avg(close) OVER (ORDER BY d ROWS 199 PRECEDING) THEN 1 ELSE 0 END END AS f_kospi_above_ma200 FROM mkt) i ON e.dip_date >= i.d
    ASOF LEFT JOIN (SELECT d, CASE WHEN row_number() OVER (ORDER BY d) >= 5 THEN vkospi_level END AS f_vkospi_at_dip, vkospi_level / lag(vkospi_level, 4) OVER (ORDER BY d) - 1 AS f_vkospi_change_5d FROM vol) v ON e.dip_date >= v.d
    ASOF LEFT JOIN gov g ON g.asset = e.asset AND e.dip_date >= g.rd""")


def _risk(s):
    return EV.governance_scores(s.disclosures(), event_universe(s)).select("asset", "rd", "governance_risk_score")


_CF = "f_kospi_drawdown_at_dip:7 f_kospi_above_ma200:0 f_vkospi_at_dip:6 f_vkospi_change_5d:6 f_quarter_end_proximity:7 f_year_end_proximity:7 f_governance_risk_score:6"
query("dip_context_features", f"asset dip_date:d {_CF}", "dcf", "SELECT * FROM dcf")(lambda s: D.context_features(dips(s), s.market(), T.realized_vol(s.market()), _risk(s)))
_IN = lambda xs: "event_category IN (" + ", ".join(f"'{x}'" for x in xs) + ")"
add_cte("def", "dips disc", f"""
    SELECT e.asset, e.dip_date, count(*) FILTER (rcept_dt >= dip_date - 5) AS f_dart_event_within_5d_pre_dip, count(*) FILTER (rcept_dt >= dip_date - 10 AND {_IN(D.NEGATIVE)}) AS f_negative_event_within_10d, count(*) FILTER (rcept_dt >= dip_date - 10 AND {_IN(D.POSITIVE)}) AS f_positive_event_within_10d,
      count(*) FILTER ({_IN(D.DILUTIVE)}) AS f_dilution_event_within_30d FROM dips e LEFT JOIN disc d ON d.asset = e.asset AND rcept_dt >= dip_date - 30 AND rcept_dt < dip_date GROUP BY 1, 2""")
_EF = "f_dart_event_within_5d_pre_dip:0 f_negative_event_within_10d:0 f_positive_event_within_10d:0 f_dilution_event_within_30d:0 f_dart_event_severity_score:1"
_DEF = "SELECT *, f_negative_event_within_10d - 0.5 * f_positive_event_within_10d AS f_dart_event_severity_score FROM def"
query("dip_event_features", f"asset dip_date:d {_EF}", "def", _DEF)(lambda s: D.event_features(dips(s), s.disclosures()))
query("events_in_window", "asset dip_date:d f_dart_event_within_5d_pre_dip:0 f_dilution_event_within_30d:0", "def", "SELECT * FROM def")(lambda s: D.event_features(dips(s), s.disclosures()))


def dip_panel(s):
    """All dips with their features, landed once for each state of the input: the model is fitted on them and scores them."""
    return s.landed("dip-panel", ["lineitem", "part", "orders", "supplier"],
                    lambda: D.dip_feature_panel(dips(s), s.bars(), s.flow(), s.market(), T.realized_vol(s.market()), s.disclosures(), _risk(s)))


query("dip_feature_panel", f"asset dip_date:d {_PF} {_VF} {_FF} {_CF} {_EF} f_dip_magnitude_pct:8", "dips dpf dvf dff dcf def", f"""
    SELECT e.asset, e.dip_date, e.drawdown_pct AS f_dip_magnitude_pct, p.* EXCLUDE (asset, d), v.* EXCLUDE (asset, d, t, ov, ad), f.* EXCLUDE (asset, dip_date), c.* EXCLUDE (asset, dip_date), x.* EXCLUDE (asset, dip_date) FROM dips e JOIN dpf p ON p.asset = e.asset AND p.d = e.dip_date JOIN dvf v ON v.asset = e.asset AND v.d = e.dip_date
    JOIN dff f ON f.asset = e.asset AND f.dip_date = e.dip_date JOIN dcf c ON c.asset = e.asset AND c.dip_date = e.dip_date JOIN ({_DEF}) x ON x.asset = e.asset AND x.dip_date = e.dip_date""")(dip_panel)

# strategies ------------------------------------------------------------------------------------
add_cte("strat", "dips", """
    SELECT asset, dip_date, label, strategy, CASE strategy WHEN 'naive_hold' THEN r WHEN 'naive_stop' THEN CASE WHEN r >= -0.08 THEN r ELSE -0.08 END WHEN 'classifier' THEN c ELSE CASE WHEN drawdown_pct <= -0.08 THEN -0.08 - 0.0031::DOUBLE ELSE c END END AS ret FROM (
      SELECT *, CASE WHEN p >= 0.65 THEN r WHEN p < 0.4 THEN drawdown_pct - 0.0031::DOUBLE ELSE 0.5 * (drawdown_pct - 0.0031::DOUBLE) + 0.5 * r END AS c FROM (
        SELECT *, greatest(-0.5, least(5, recovery_close / dip_low_close - 1)) AS r, (dip_low_close % 1000) / 1000 AS p FROM dips)), (VALUES ('naive_hold'), ('naive_stop'), ('classifier'), ('hybrid')) v(strategy)""")


def strategies(s):
    return EP.episode_strategy_returns(dips(s).withColumn("p", F.pmod(F.col("dip_low_close"), F.lit(1000.0)) / 1000), "p")


query("episode_strategy_returns", "asset dip_date:d strategy ret:8", "strat", "SELECT * FROM strat")(strategies)
query("strategy_summary", "strategy n_episodes:i mean_return:7 median_return:7 hit_rate:7 left_tail_5pct_loss:7 stdev:7 n_labeled_used:i", "strat", """
    SELECT strategy, count(ret) AS n_episodes, avg(ret) AS mean_return, median(ret) AS median_return, avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0 END) AS hit_rate, quantile_cont(ret, 0.05) AS left_tail_5pct_loss, stddev_samp(ret) AS stdev, count(label) AS n_labeled_used FROM strat GROUP BY 1""")(
    lambda s: EP.strategy_summary(strategies(s)))
