"""Themes and industries."""

from pyspark.sql import functions as F

from panelspark.catalog.flow_macro import _z
from panelspark.catalog.registry import add_cte, query
from panelspark.catalog.xsection import rank_sql
from panelspark.operators import themes as TH
from panelspark.operators.xsection import rank_in_date

add_cte("aret", "bars", "SELECT asset, d, close, close / lag(close) OVER (PARTITION BY asset ORDER BY d) - 1 AS ret FROM bars")
add_cte("comp", "aret themes", "SELECT theme, d, avg(ret) AS ret, count(close) AS n_active FROM aret JOIN themes USING (asset) GROUP BY 1, 2")


def _strength(key: str, src: str) -> str:
    w = f"PARTITION BY {key} ORDER BY d"
    cum = lambda c, n: f"exp({c} - lag({c}, {n}) OVER ({w})) - 1"
    ab = ", ".join(f"{cum('s', n)} AS abs_return_{n}d" for n in TH.HORIZONS)
    rs = ", ".join(f"({cum('s', n)}) - ({cum('sb', n)}) AS rs_kospi_{n}d" for n in (5, 20, 60, 252))
    return f"""SELECT *, {_z('rs_kospi_20d', 60, 20, f'PARTITION BY {key}')} AS rs_kospi_20d_zscore_60d FROM (SELECT * EXCLUDE (s, sb), s AS lvl, {ab}, {rs} FROM (
      SELECT t.*, sum(ln(1 + coalesce(ret, 0))) OVER ({w}) AS s, sum(ln(1 + coalesce(b, 0))) OVER ({w}) AS sb FROM {src} t LEFT JOIN (SELECT d, close / lag(close) OVER (ORDER BY d) - 1 AS b FROM mkt) USING (d)))"""


add_cte("tstr", "comp mkt", _strength("theme", "comp"))
add_cte("istr", "idx mkt", _strength("index_id", "(SELECT index_id, d, close / lag(close) OVER (PARTITION BY index_id ORDER BY d) - 1 AS ret FROM idx)"))
add_cte("tstage", "tstr", """
    SELECT *, CASE WHEN z <= -2.5 AND rs60 <= 0 THEN 'markdown' WHEN rs60 < -0.05 AND a120 < 0 THEN 'markdown' WHEN rs60 < -0.02 AND a60 < 0 THEN 'distribute' WHEN rs20 > 0.05 AND a20 > 0 THEN 'markup' WHEN abs(a60) < 0.05 AND rs60 > -0.02 THEN 'accumulate' ELSE 'transition' END AS stage FROM (
      SELECT theme, d, lvl, rs_kospi_60d, rs_kospi_20d, abs_return_60d, rs_kospi_20d_zscore_60d AS z, rs_kospi_60d AS rs60, rs_kospi_20d AS rs20, abs_return_20d AS a20, abs_return_60d AS a60, abs_return_120d AS a120 FROM tstr)""")


def _rank(df, score, k, keys):
    return rank_in_date(df, score, k, keys, out="r")


def strength(s):
    return TH.theme_strength(TH.composite_returns(s.bars(), s.themes()), s.market())


def staged(s):
    return strength(s).withColumn("stage", TH.lifecycle_stage())


_ST = " ".join(f"abs_return_{n}d:7" for n in TH.HORIZONS) + " " + " ".join(f"rs_kospi_{n}d:7" for n in (5, 20, 60, 252)) + " rs_kospi_20d_zscore_60d:5"
query("composite_returns", "theme d:d ret:8 n_active:i", "comp", "SELECT * FROM comp")(lambda s: TH.composite_returns(s.bars(), s.themes()))
query("theme_strength", f"theme d:d {_ST}", "tstr", "SELECT * FROM tstr")(strength)
query("index_strength", f"index_id d:d {_ST}", "istr", "SELECT * FROM istr")(lambda s: TH.index_strength(s.index_bars(), s.market()))
query("lifecycle_stage", "theme d:d stage", "tstage", "SELECT * FROM tstage")(staged)
query("stage_counts", "stage n:i", "tstage", "SELECT stage, count(*) AS n FROM tstage GROUP BY 1")(lambda s: TH.stage_counts(staged(s)))
query("stage_changes", "theme d:d previous_stage stage", "tstage", "SELECT * FROM (SELECT *, lag(stage) OVER w AS previous_stage, lag(d) OVER w AS pd FROM tstage WINDOW w AS (PARTITION BY theme ORDER BY d)) WHERE previous_stage <> stage AND d - pd <= 10")(
    lambda s: TH.stage_changes(staged(s)))
query("lead_score_topk", "theme d:d lead_score:6", "tstage", "SELECT theme, d, round(coalesce(rs60, 0) + 0.5 * coalesce(rs20, 0), 9) AS lead_score FROM tstage ORDER BY lead_score DESC, theme || CAST(d AS VARCHAR) LIMIT 50")(
    lambda s: TH.global_topk(strength(s).select("theme", "d", F.round(TH.lead_score(), 9).alias("lead_score"), F.concat("theme", F.col("d").cast("string")).alias("k")), "lead_score", 50, "k"))
query("global_bottomk", "asset d:d close:2", "bars", "SELECT * FROM bars ORDER BY close, asset || CAST(d AS VARCHAR) LIMIT 40")(
    lambda s: TH.global_topk(s.bars().withColumn("k", F.concat("asset", F.col("d").cast("string"))), "close", 40, "k", False))
add_cte("ind", "aret assets mcap", """
    SELECT industry, d, avg(ret) AS ret, any_value(n_leaders) AS n_leaders FROM aret JOIN (SELECT *, count(*) OVER (PARTITION BY industry) AS n_leaders FROM (SELECT industry, asset, row_number() OVER (PARTITION BY industry ORDER BY mc DESC, asset) AS r FROM (
      SELECT industry, a.asset, coalesce(mc, 0) AS mc, count(*) OVER (PARTITION BY industry) AS n FROM assets a LEFT JOIN (SELECT asset, arg_max(market_cap, snapshot_date) AS mc FROM mcap GROUP BY 1) m ON m.asset = a.asset) WHERE n >= 3) WHERE r <= 5) USING (asset) GROUP BY 1, 2""")
query("industry_strength", "industry:i d:d ret:8 n_leaders:i", "ind", "SELECT * FROM ind")(lambda s: TH.industry_strength(s.bars(), s.assets().select("asset", "industry"), s.mcap()))
query("top_codes", "industry:i n:i", "assets", "SELECT industry, count(*) AS n FROM assets GROUP BY 1 ORDER BY n DESC, industry LIMIT 20")(
    lambda s: TH.global_topk(s.assets().groupBy("industry").agg(F.count(F.lit(1)).alias("n")), "n", 20, "industry"))
query("nlargest_per_group", "sector asset listed_shares:i r:i", "assets", "SELECT * FROM (SELECT sector, asset, listed_shares, row_number() OVER (PARTITION BY sector ORDER BY listed_shares DESC, asset) AS r FROM assets) WHERE r <= 5")(
    lambda s: _rank(s.assets(), "listed_shares", 5, ["sector"]))
query("top_by_mcap", "market snapshot_date:d asset r:i", "mcap", "SELECT * FROM (SELECT market, snapshot_date, asset, row_number() OVER (PARTITION BY market, snapshot_date ORDER BY market_cap DESC, asset) AS r FROM mcap) WHERE r <= 10")(
    lambda s: _rank(s.mcap(), "market_cap", 10, ["market", "snapshot_date"]))


query("latest_n_rows", "asset d:d foreign_net:0 r:i", "flow", "SELECT * FROM (SELECT asset, d, foreign_net, row_number() OVER (PARTITION BY asset ORDER BY d DESC) AS r FROM flow) WHERE r <= 5")(lambda s: _rank(s.flow(), "d", 5, ["asset"]))
query("quarterly_leaders", "quarter theme mean_return_60d:7 rank:i", "tstr", """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY quarter ORDER BY mean_return_60d DESC, theme) AS rank FROM (SELECT year(d) || 'Q' || quarter(d) AS quarter, theme, round(avg(abs_return_60d), 12) AS mean_return_60d FROM tstr GROUP BY 1, 2) WHERE mean_return_60d IS NOT NULL) WHERE rank <= 5""")(
    lambda s: TH.quarterly_leaders(strength(s)))


def weeks(s):
    w = F.sum(F.log1p(F.coalesce("ret", F.lit(0.0)))).over(TH.series("theme").rowsBetween(TH.Window.unboundedPreceding, 0))
    return TH.weekly(staged(s).select("theme", "d", "stage", F.exp(w).alias("level")))


add_cte("wk", "tstage", "SELECT theme, date_trunc('week', d) AS week, max(d) AS d, arg_max(stage, d) AS stage, exp(arg_max(lvl, d)) AS level FROM tstage GROUP BY 1, 2")
add_cte("wks", "wk", "SELECT *, sum(CASE WHEN stage IN ('distribute', 'markdown') THEN 1 ELSE 0 END) OVER (PARTITION BY theme, g ORDER BY d) AS bad_streak FROM (SELECT *, sum(CASE WHEN stage IN ('distribute', 'markdown') THEN 0 ELSE 1 END) OVER (PARTITION BY theme ORDER BY d) AS g FROM wk)")
query("bad_stage_streak", "theme d:d stage bad_streak:i confirmed", "wks", "SELECT *, bad_streak >= 3 AS confirmed FROM wks")(lambda s: TH.bad_stage_streak(weeks(s)))
query("entry_exit_signals", "theme d:d stage entry exit_now:b position_return:6", "wks", """
    SELECT *, coalesce((bad_streak >= 3 OR position_return <= -0.3) AND position_return IS NOT NULL, false) AS exit_now FROM (SELECT *, level / last_value(CASE WHEN entry THEN level END IGNORE NULLS) OVER (PARTITION BY theme ORDER BY d) - 1 AS position_return FROM (
      SELECT *, stage = 'markup' AND coalesce(lag(stage) OVER (PARTITION BY theme ORDER BY d) <> 'markup', true) AS entry FROM wks))""")(
    lambda s: TH.entry_exit_signals(weeks(s)).withColumn("exit_now", F.col("exit")))
add_cte("cand", "keys bars themes", f"""
    SELECT k.rd, t.theme, k.asset, dist, round(vol_z, 9) AS vol_z FROM (SELECT k.rd, k.asset, f.* EXCLUDE (asset, d) FROM keys k ASOF LEFT JOIN (
      SELECT asset, d, t + 1 AS nb, CASE WHEN t >= 251 THEN close / max(close) OVER (PARTITION BY asset ORDER BY d ROWS 251 PRECEDING) - 1 END AS dist, CASE WHEN t >= 59 AND stddev_samp(volume) OVER w > 0 THEN (volume - avg(volume) OVER w) / stddev_samp(volume) OVER w ELSE 0 END AS vol_z
      FROM bars WINDOW w AS (PARTITION BY asset ORDER BY d ROWS 59 PRECEDING)) f ON f.asset = k.asset AND k.rd >= f.d) k JOIN themes t ON t.asset = k.asset WHERE nb >= 60""")
add_cte("tlead", "cand", f"SELECT *, round(0.5 * greatest(0, least(1, 1 + coalesce(dist, -0.5))) + 0.3 * vr + 0.1, 9) AS composite_score, round(0.6 * (0.7 * greatest(0, least(1, 1 + coalesce(dist, -0.5))) + 0.3 * vr) + 0.4 * vr, 9) AS blended FROM (SELECT *, {rank_sql('vol_z', 'rd, theme')} AS vr FROM cand)")
query("theme_leaders", "theme rd:d asset composite_score:6 rank:i", "tlead", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY theme, rd ORDER BY composite_score DESC, asset) AS rank FROM tlead) WHERE rank <= 3")(
    lambda s: TH.theme_leaders(s.bars(), s.themes(), s.keys()))


@query("theme_leaders_blended", "theme rd:d asset composite_score:6 rank:i", "cand mclose", f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY theme, rd ORDER BY composite_score DESC, asset) AS rank FROM (
      SELECT *, round(0.6 * (0.7 * greatest(0, least(1, 1 + coalesce(dist, -0.5))) + 0.3 * {rank_sql('vol_z', 'rd, theme')}) + 0.4 * {rank_sql('p', 'rd, theme')}, 9) AS composite_score FROM (SELECT c.*, close AS p FROM cand c JOIN mclose m USING (asset, rd)))) WHERE rank <= 3""")
def _(s):
    return TH.theme_leaders(s.bars(), s.themes(), s.keys(), blended=True, p_scores=s.month_closes().withColumnRenamed("close", "p"))
