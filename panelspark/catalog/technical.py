"""Technical indicators."""

from pyspark.sql import functions as F

from panelspark.catalog.registry import add_cte, query
from panelspark.operators import technical as T

add_cte("ma", "bars", "SELECT asset, d, t, close, volume, " + ", ".join(
    f"CASE WHEN t >= {n - 1} THEN avg(close) OVER (PARTITION BY asset ORDER BY d ROWS {n - 1} PRECEDING) END AS ma_{n}" for n in T.SMA_WINDOWS) + " FROM bars")
add_cte("x52", "bars", """
    SELECT asset, d, high_52w, low_52w, close / high_52w - 1 AS dist_from_52w_high, close / low_52w - 1 AS dist_from_52w_low, coalesce(close >= high_52w * 0.999::DOUBLE, false) AS new_52w_high_flag
    FROM (SELECT asset, d, close, CASE WHEN t >= 4 THEN max(close) OVER w END AS high_52w, CASE WHEN t >= 4 THEN min(close) OVER w END AS low_52w FROM bars WINDOW w AS (PARTITION BY asset ORDER BY d ROWS 251 PRECEDING))""")
add_cte("vst", "bars", """
    SELECT asset, d, m AS volume_ma_50, CASE WHEN m IS NOT NULL THEN CASE WHEN sd > 0 THEN (volume - m) / sd ELSE 0 END END AS volume_zscore_50, v5 / m AS volume_dryup_pct
    FROM (SELECT asset, d, volume, CASE WHEN t >= 49 THEN avg(volume) OVER w END AS m, CASE WHEN t >= 49 THEN stddev_samp(volume) OVER w END AS sd, avg(volume) OVER (PARTITION BY asset ORDER BY d ROWS 4 PRECEDING) AS v5
          FROM bars WINDOW w AS (PARTITION BY asset ORDER BY d ROWS 49 PRECEDING))""")
add_cte("chg", "bars", """
    SELECT asset, d, t, close, CASE WHEN pc IS NULL THEN 0 ELSE greatest(close - pc, 0) END AS g, CASE WHEN pc IS NULL THEN 0 ELSE greatest(pc - close, 0) END AS l,
      CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr
    FROM (SELECT *, lag(close) OVER (PARTITION BY asset ORDER BY d) AS pc FROM bars)""")
add_cte("ewm", "chg", """
    SELECT asset, t, g AS ag, l AS al, tr AS a14, tr AS a20, tr AS a60 FROM chg WHERE t = 0 UNION ALL
    SELECT c.asset, c.t, e.ag * (13 / 14::DOUBLE) + c.g / 14, e.al * (13 / 14::DOUBLE) + c.l / 14, e.a14 * (13 / 14::DOUBLE) + c.tr / 14, e.a20 * 0.95::DOUBLE + c.tr / 20, e.a60 * (59 / 60::DOUBLE) + c.tr / 60
    FROM ewm e JOIN chg c ON c.asset = e.asset AND c.t = e.t + 1""")
add_cte("wil", "ewm chg", """
    SELECT c.asset, c.d, CASE WHEN c.t >= 14 AND al > 0 THEN 100 - 100 / (1 + ag / al) END AS rsi_14, CASE WHEN c.t >= 14 THEN a14 END AS atr_14, CASE WHEN c.t >= 14 THEN a14 / close END AS atr_pct,
      CASE WHEN c.t >= 20 THEN a20 / close END AS p20, CASE WHEN c.t >= 60 THEN a60 / close END AS p60 FROM chg c JOIN ewm e USING (asset, t)""")
add_cte("boll", "bars", """
    SELECT asset, d, m + 2 * s AS bb_upper_20, m - 2 * s AS bb_lower_20, CASE WHEN 4 * s >= 1e-9 THEN greatest(0, least(1, (close - (m - 2 * s)) / (m + 2 * s - (m - 2 * s)))) END AS bb_position
    FROM (SELECT asset, d, close, CASE WHEN t >= 19 THEN avg(close) OVER w END AS m, CASE WHEN t >= 19 THEN stddev_samp(close) OVER w END AS s FROM bars WINDOW w AS (PARTITION BY asset ORDER BY d ROWS 19 PRECEDING))""")
add_cte("prev200", "ma", "SELECT *, lag(ma_200, 20) OVER (PARTITION BY asset ORDER BY d) AS prev, close / lag(close, 251) OVER (PARTITION BY asset ORDER BY d) - 1 AS own FROM ma")
add_cte("stage", "prev200", """
    SELECT asset, d, CASE WHEN t < 219 OR prev IS NULL THEN 'unknown' WHEN close > ma_200 * 1.02::DOUBLE AND ma_200 / prev - 1 > 0.005::DOUBLE THEN '2_uptrend'
      WHEN close < ma_200 * 0.98::DOUBLE AND ma_200 / prev - 1 < -0.005::DOUBLE THEN '4_decline' WHEN close > ma_200 * 1.02::DOUBLE THEN '3_topping' ELSE '1_basing' END AS stage_label FROM prev200""")
add_cte("tt", "prev200 x52 mkt", """
    SELECT p.asset, p.d, CASE WHEN p.t < 219 THEN 0 ELSE CAST(close > ma_150 AND close > ma_200 AS INT) + CAST(ma_150 > ma_200 AS INT) + CAST(coalesce(ma_200 / prev - 1 > 0.005::DOUBLE, false) AS INT)
      + CAST(ma_50 > ma_150 AND ma_150 > ma_200 AS INT) + CAST(close > ma_50 AS INT) + CAST(close >= low_52w * 1.25::DOUBLE AS INT) + CAST(close >= high_52w * 0.75::DOUBLE AS INT) + CAST(coalesce(own > ir, false) AS INT) END AS trend_template_score
    FROM prev200 p JOIN x52 USING (asset, d) JOIN (SELECT d, close / lag(close, 251) OVER (ORDER BY d) - 1 AS ir FROM mkt) i ON i.d = p.d""".replace("CAST(close > ma_150 AND close > ma_200 AS INT)", "CAST(coalesce(close > ma_150 AND close > ma_200, false) AS INT)"))
add_cte("tech", "ma x52 vst wil boll stage tt", """
    SELECT *, volume_zscore_50 > 1.5 AND new_52w_high_flag AS brk FROM ma JOIN x52 USING (asset, d) JOIN vst USING (asset, d) JOIN wil USING (asset, d) JOIN boll USING (asset, d) JOIN stage USING (asset, d) JOIN tt USING (asset, d)""")

query("sma", "asset d:d " + " ".join(f"ma_{n}:6" for n in T.SMA_WINDOWS), "ma", "SELECT * FROM ma")(lambda s: T.sma(s.bars()))
query("ma_stack_aligned", "asset d:d ma_stack_aligned", "ma", "SELECT asset, d, coalesce(close > ma_20 AND ma_20 > ma_50 AND ma_50 > ma_150 AND ma_150 > ma_200, false) AS ma_stack_aligned FROM ma")(
    lambda s: T.ma_stack_aligned(T.sma(s.bars())))
query("extremes_52w", "asset d:d high_52w:2 low_52w:2 dist_from_52w_high:6 dist_from_52w_low:6 new_52w_high_flag", "x52", "SELECT * FROM x52")(lambda s: T.extremes_52w(s.bars()))
query("volume_stats", "asset d:d volume_ma_50:4 volume_zscore_50:6 volume_dryup_pct:6", "vst", "SELECT * FROM vst")(lambda s: T.volume_stats(s.bars()))
query("rsi_wilder", "asset d:d rsi_14:6 rsi_overbought rsi_oversold", "wil", "SELECT asset, d, rsi_14, coalesce(rsi_14 > 70, false) AS rsi_overbought, coalesce(rsi_14 < 30, false) AS rsi_oversold FROM wil")(lambda s: T.wilder(s.bars()))
query("atr_wilder", "asset d:d atr_14:5 atr_pct_14:6", "wil", "SELECT asset, d, atr_14, atr_pct AS atr_pct_14 FROM wil")(lambda s: T.wilder(s.bars()))
query("bollinger", "asset d:d bb_upper_20:5 bb_lower_20:5 bb_position:6", "boll", "SELECT * FROM boll")(lambda s: T.bollinger(s.bars()))
query("vol_contraction", "asset d:d vol_contraction:6", "wil", "SELECT asset, d, p20 / p60 AS vol_contraction FROM wil")(lambda s: T.vol_contraction(T.wilder(s.bars())))
query("weinstein_stage", "asset d:d stage_label", "stage", "SELECT * FROM stage")(lambda s: T.weinstein_stage(T.sma(s.bars(), (200,))))
query("trend_template", "asset d:d trend_template_score:i trend_template_pass", "tt", "SELECT *, trend_template_score >= 7 AS trend_template_pass FROM tt")(
    lambda s: T.trend_template(T.extremes_52w(T.sma(s.bars())), s.market()))
query("breakout_and_distances", "asset d:d breakout_flag dist_from_ma_50:6 dist_from_ma_150:6 dist_from_ma_200:6", "ma x52 vst",
      "SELECT asset, d, new_52w_high_flag AND coalesce(volume_zscore_50, 0) > 1.5 AS breakout_flag, close / ma_50 - 1 AS dist_from_ma_50, close / ma_150 - 1 AS dist_from_ma_150, close / ma_200 - 1 AS dist_from_ma_200 FROM ma JOIN x52 USING (asset, d) JOIN vst USING (asset, d)")(
    lambda s: T.breakout_and_distances(T.volume_stats(T.extremes_52w(T.sma(s.bars())))))
query("technical_features", "asset rd:d ma_20:6 ma_200:6 ma_stack:b dist_from_52w_high:6 volume_zscore_50:6 rsi_14:6 atr_pct:6 bb_position:6 vol_contraction:6 stage_label trend_template_score:i breakout_flag:b", "keys tech", """
    SELECT k.asset, k.rd, ma_20, ma_200, coalesce(close > ma_20 AND ma_20 > ma_50 AND ma_50 > ma_150 AND ma_150 > ma_200, false) AS ma_stack, dist_from_52w_high, volume_zscore_50, rsi_14, atr_pct, bb_position,
      p20 / p60 AS vol_contraction, coalesce(stage_label, 'unknown') AS stage_label, coalesce(trend_template_score, 0) AS trend_template_score, coalesce(brk, false) AS breakout_flag
    FROM keys k ASOF LEFT JOIN tech t ON k.asset = t.asset AND k.rd >= t.d""")(
    lambda s: T.technical_at(s.bars(), s.market(), s.keys()).withColumn("ma_stack", F.col("ma_stack_aligned")))
add_cte("vol", "mkt", """
    SELECT d, v * sqrt(252) * 100 AS vkospi_level FROM (SELECT d, CASE WHEN count(r) OVER w >= 10 THEN stddev_samp(r) OVER w END AS v FROM
      (SELECT d, ln(close / lag(close) OVER (ORDER BY d)) AS r FROM mkt) WINDOW w AS (ORDER BY d ROWS 19 PRECEDING)) WHERE v IS NOT NULL""")
query("realized_vol", "d:d vkospi_level:6", "vol", "SELECT * FROM vol")(lambda s: T.realized_vol(s.market()))

_GATES = """
    SELECT asset, d, CAST((p20 / p60 IS NOT NULL OR coalesce(rsi_14 < 30, false)) AND abs(coalesce(dist_from_52w_high, 0)) < 0.25 AS DOUBLE) AS pre,
      CAST((trend_template_score >= 7 AND coalesce(close > ma_20 AND ma_20 > ma_50 AND ma_50 > ma_150 AND ma_150 > ma_200, false)) OR new_52w_high_flag AS DOUBLE) AS cont,
      1 - CAST(coalesce(close / ma_50 - 1, 0) < -0.05 AND coalesce(volume_zscore_50, 0) > 2 AND trend_template_score < 7 AS DOUBLE) AS ex, volume FROM tech"""
query("trend_gate", "asset d:d pre:1 cont:1 ex:1", "tech", _GATES)(
    lambda s: T.technical_features(s.bars(), s.market()).select("asset", "d", T.trend_gate("pre_entry").alias("pre"), T.trend_gate("continuation").alias("cont"), T.trend_gate("exit").alias("ex")))
query("apply_trend_gate", "asset d:d score_trend_gated:4", "tech", f"SELECT asset, d, volume * (cont + 0.5 * (1 - cont)) AS score_trend_gated FROM ({_GATES})")(
    lambda s: T.apply_trend_gate(T.technical_features(s.bars(), s.market()), "volume", "continuation"))
