"""Whole-panel compositions."""

from pyspark.sql import functions as F

from panelspark.catalog.flow_macro import derivatives, macro_panel
from panelspark.catalog.fundamental_events import E, event_universe, features, valuations
from panelspark.catalog.registry import add_cte, query
from panelspark.catalog.portfolio import P, periods
from panelspark.catalog.xsection import momentum, rank_sql, scored
from panelspark.operators import universe as U, xsection as XS
from panelspark.plans import panel as PL
from panelspark.sources.files import materialize
from panelspark.sources.normalize import pivot_investor_classes

ALL = {"fundamental", "events", "governance", "flow", "derivatives", "macro", "technical", "regime"}
CFG = U.Eligibility(min_trading_value=1e5, min_market_cap=5e11, min_listed_months=1, exclude_preferred=False)


def inputs(s):
    return PL.Inputs(
        bars=s.bars(), index_bars=s.index_bars(), market=s.market(), snapshots=materialize(s.listed(), "snapshots"), names=s.assets(), dates=s.month_ends().select("rd"), fundamentals=s.fundamentals(amended=True),
        valuations=valuations(s), disclosures=s.disclosures(), flow=s.flow(), market_flow=pivot_investor_classes(s.investor_flow()), macro_daily=macro_panel(s), derivatives=derivatives(s))


query("scored_panel", "asset rd:d ret_12_1m:6 momentum_score:6 value_score:6 quality_score:6 disclosure_event_total_score:6 governance_risk_score:6 rsi_14:4 foreign_inst_combined_zscore_20d:6 macro_vix:6 vkospi_level:4 regime_label_kr blended_score_p1:6 blended_score_p2:6 momentum_score_rank:6 momentum_score_sector_rank:6")(
    lambda s: PL.scored_panel(inputs(s), CFG, ALL))
add_cte("blend", "mscore ff evs", """
    SELECT m.asset, m.rd, momentum_score, value_score, quality_score, turnaround_score, coalesce(disclosure_event_total_score, 0) AS ev FROM mscore m JOIN ff f ON f.asset = m.asset AND f.rd = m.rd LEFT JOIN evs e ON e.asset = m.asset AND e.rd = m.rd""")


def blend_inputs(s):
    ev = E.event_scores(s.disclosures(), event_universe(s)).select("asset", "rd", "disclosure_event_total_score")
    return XS.momentum_score(momentum(s)).select("asset", "rd", "momentum_score").join(features(s).select("asset", "rd", "value_score", "quality_score", "turnaround_score"), ["asset", "rd"]).join(ev, ["asset", "rd"], "left")


query("blended_scores", "asset rd:d blended_score_p1:6 blended_score_p2:6", "blend", """
    SELECT asset, rd, 0.4 * momentum_score + 0.25 * value_score + 0.25 * quality_score + 0.1 * turnaround_score AS blended_score_p1, 0.3 * momentum_score + 0.2 * value_score + 0.2 * quality_score + 0.1 * turnaround_score + 0.2 * ev AS blended_score_p2 FROM blend""")(
    lambda s: PL.blended_scores(blend_inputs(s)))
query("combination_scores", "strategy asset rd:d score:6", "blend", """
    SELECT strategy, asset, rd, CASE WHEN p1 AND p2 THEN 0.3 * momentum_score + 0.2 * value_score + 0.2 * quality_score + 0.1 * turnaround_score + 0.2 * ev WHEN p1 THEN 0.4 * momentum_score + 0.25 * value_score + 0.25 * quality_score + 0.1 * turnaround_score
      WHEN p2 THEN (0.3 * momentum_score + 0.2 * ev) / 0.5 ELSE momentum_score END AS score FROM blend, (VALUES ('P0_only', false, false), ('P0+P1', true, false), ('P0+P2_events', false, true), ('P0+P2.5_flow', false, false), ('P0+P3_technical', false, false), ('P0+P1+P2+P3', true, true)) c(strategy, p1, p2)""")(
    lambda s: P.combination_scores(blend_inputs(s)))
query("composite_pick_score", "asset rd:d composite_score:8", "mclose mom", f"""
    SELECT asset, rd, 0.5 * {rank_sql('close')} + 0.5 * {rank_sql('ret_12_1m')} AS composite_score FROM (SELECT m.asset, m.rd, close, ret_12_1m FROM mclose m JOIN mom USING (asset, rd))""")(
    lambda s: PL.composite_pick_score(momentum(s).join(s.month_closes(), ["asset", "rd"]), "close", "ret_12_1m"))


@query("phase_combination_matrix", "strategy n:i mean_gross:6")
def _(s):
    sel = XS.rank_in_date(P.combination_scores(blend_inputs(s)).withColumn("score", F.round("score", 9)), "score", 10, P.KEY)
    return P.backtest_periods(P.weights(sel, "equal"), s.bars(), periods(s)).groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.avg("gross_return").alias("mean_gross"))


@query("topn_auto", "asset rd:d rank:i score_col_used", "scored", "SELECT asset, rd, 'momentum_score' AS score_col_used, rank FROM (SELECT *, row_number() OVER (PARTITION BY rd ORDER BY score DESC, asset) AS rank FROM scored) WHERE rank <= 10")
def _(s):
    return PL.topn_auto(scored(s).select("asset", "rd", F.col("score").alias("momentum_score"), F.lit(0.0).alias("blended_score_p2")), 10)


add_cte("mp0", "mclose mom gov mcap", f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rd ORDER BY cs DESC, asset) AS rank FROM (SELECT asset, rd, risk, round((0.5 * {rank_sql('adj')} + 0.5 * {rank_sql('ret_12_1m')}) / 1.0, 12) AS cs FROM (
      SELECT m.asset, m.rd, g.governance_risk_score AS risk, m.close / 1e5 * (1 - 0.35::DOUBLE * g.governance_risk_score) AS adj, ret_12_1m FROM mclose m JOIN mom o ON o.asset = m.asset AND o.rd = m.rd JOIN gov g ON g.asset = m.asset AND g.rd = m.rd JOIN mcap c ON c.asset = m.asset AND c.snapshot_date = m.rd
      WHERE g.governance_hard_veto_flag < 0.5 AND c.market_cap >= 5e11))) WHERE rank <= 20""")


@query("monthly_picks", "asset rd:d rank:i composite_score:8 weight:8", "mp0", """
    SELECT asset, rd, rank, cs AS composite_score, CASE WHEN sum(c) OVER (PARTITION BY rd) > 0 THEN c / sum(c) OVER (PARTITION BY rd) ELSE c END AS weight FROM (
      SELECT *, CASE WHEN risk >= 0.8 THEN 0 WHEN risk >= 0.6 THEN least(w, 0.02) WHEN risk >= 0.4 THEN least(w, 0.04) ELSE w END AS c FROM (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY rd) AS w FROM mp0))""")
def _(s):
    g = E.governance_scores(s.disclosures(), event_universe(s)).select("asset", "rd", "market_cap", "governance_risk_score", "governance_hard_veto_flag")
    p = s.month_closes().select("asset", "rd", (F.col("close") / 1e5).alias("p_pre_surge")).join(momentum(s), ["asset", "rd"]).join(g, ["asset", "rd"])
    return PL.monthly_picks(p, 20, mcap_lo=5e11, weighting="equal")
