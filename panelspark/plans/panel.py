"""Whole-panel compositions: the scored feature panel and the monthly picks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from panelspark.functions.feature_groups import GROUPS, with_feature_group
from panelspark.functions.scalars import weighted_blend, z0
from panelspark.operators import events as EV, flow as FL, fundamental as FU, macro as MA, portfolio as P, regime as RG, technical as TE, universe as U, xsection as XS
from panelspark.sources.files import materialize

# Weights of the blended scores.
BLEND_P1 = {"momentum_score": 0.40, "value_score": 0.25, "quality_score": 0.25, "turnaround_score": 0.10}
BLEND_P2 = {"momentum_score": 0.30, "value_score": 0.20, "quality_score": 0.20, "turnaround_score": 0.10, "disclosure_event_total_score": 0.20}


@dataclass
class Inputs:
    """The tables a panel is built from; optional ones switch their feature group off."""

    bars: DataFrame
    index_bars: DataFrame
    market: DataFrame
    snapshots: DataFrame
    names: DataFrame
    dates: DataFrame
    fundamentals: DataFrame | None = None
    valuations: DataFrame | None = None
    disclosures: DataFrame | None = None
    flow: DataFrame | None = None
    market_flow: DataFrame | None = None
    macro_daily: DataFrame | None = None
    derivatives: DataFrame | None = None


def blended_scores(df: DataFrame) -> DataFrame:
    df = df.withColumn("blended_score_p1", weighted_blend(df.columns, BLEND_P1))
    return df.withColumn("blended_score_p2", weighted_blend(df.columns, BLEND_P2))


def scored_panel(x: Inputs, cfg: U.Eligibility, groups: set[str]) -> DataFrame:
    """Eligible universe x all rebalance dates with every enabled feature group and the blended scores.

    The universe is written once; each feature block then reads only its keys, and the blocks
    come back together on (asset, rd).
    """
    keep = ["asset", "rd", "market", "market_cap", "name", "sector", "group_flag"]
    uni = U.universe_panel(x.snapshots, x.bars, x.names, x.dates, cfg).filter("eligible").join(x.names.select("asset", "sector", "group_flag"), "asset", "left").select(*keep)
    uni = materialize(uni, "universe")
    keys = uni.select("asset", "rd")
    out = uni.join(XS.momentum_score(XS.momentum_features(x.bars, x.index_bars, keys)).drop("ret_12_1m_z", "ret_6m_z", "rs_kospi_12m_z"), ["asset", "rd"], "left")

    def attach(name: str, block: DataFrame | None) -> None:
        nonlocal out
        on = name in groups and block is not None
        if on:
            out = out.join(block, ["asset", "rd"] if "asset" in block.columns else "rd", "left")
        out = with_feature_group(out, name, on)

    fund = None
    if "fundamental" in groups and x.fundamentals is not None:
        base = FU.valuation_snapshot(keys, x.valuations) if x.valuations is not None else keys
        fund = FU.fundamental_features(base, x.fundamentals)
    attach("fundamental", fund)
    events = EV.event_scores(x.disclosures, uni).select("asset", "rd", *GROUPS["events"]) if "events" in groups and x.disclosures is not None else None
    attach("events", events)
    gov = EV.governance_scores(x.disclosures, uni).select("asset", "rd", *GROUPS["governance"]) if "governance" in groups and x.disclosures is not None else None
    attach("governance", gov)
    flow = None
    if "flow" in groups and x.flow is not None:
        flow = FL.asof_ticker_flow(FL.ticker_flow_signals(x.flow), keys).join(FL.asof_holding_change(x.flow, keys), ["asset", "rd"])
        if x.market_flow is not None:
            flow = FL.broadcast_snapshot(flow, FL.asof_market_flow(FL.market_flow_signals(x.market_flow), x.dates))
    attach("flow", flow)
    attach("derivatives", MA.asof_panel(x.derivatives, x.dates, GROUPS["derivatives"]) if "derivatives" in groups and x.derivatives is not None else None)
    attach("macro", MA.asof_panel_lagged(x.macro_daily, x.dates, GROUPS["macro"]) if "macro" in groups and x.macro_daily is not None else None)
    attach("technical", TE.technical_at(x.bars, x.market, keys) if "technical" in groups else None)
    out = blended_scores(out)
    out = XS.sector_neutral_ranks(XS.percentile_ranks(out, ["rd"], ["asset"], ["ret_12_1m", "momentum_score"]), ["momentum_score"])
    return with_feature_group(out, "regime", False) if "regime" not in groups else add_regime(out)


def add_regime(panel: DataFrame) -> DataFrame:
    """Regime per date from the panel's own broadcast columns; the trend flag is the share of aligned assets."""
    first = lambda c: F.max(c).alias(c)
    carried = ["vkospi_level", "vkospi_zscore_60d", "macro_usd_krw", "macro_usd_krw_zscore_60d", "macro_usd_krw_change_20d", "macro_bok_rate_change_60d", "macro_kr_pmi",
               "market_foreign_cumulative_60d", "market_foreign_net_buy_20d_kospi"]
    per = panel.groupBy("rd").agg((F.avg(F.col("ma_stack_aligned").cast("double")) > 0.3).alias("kospi_above_ma200"), *[first(c) for c in carried])
    per = per.withColumn("kospi_5d_return", F.lit(None).cast("double"))
    per = per.withColumn("regime_label_kr", RG.classify_regime())
    per = per.withColumns(RG.regime_multipliers(F.col("regime_label_kr"))).withColumns({
        "vkospi_zscore_63d": F.col("vkospi_zscore_60d"), "usd_krw_change_20d": F.col("macro_usd_krw_change_20d"),
        "foreign_kospi_cumulative_5d": F.col("market_foreign_cumulative_60d"), "bok_rate_change_60d": F.col("macro_bok_rate_change_60d")})
    return FL.broadcast_snapshot(panel, per.select("rd", *GROUPS["regime"]))


def topn_auto(panel: DataFrame, n: int) -> DataFrame:
    """Best n per date by the blended score where it carries signal, else by momentum; the choice is recorded."""
    use = panel.agg(F.coalesce(F.sum(F.abs(z0(F.col("blended_score_p2")))) > 0, F.lit(False)).alias("u")).scalar()
    df = panel.withColumn("_s", F.when(use, F.col("blended_score_p2")).otherwise(F.col("momentum_score")))
    df = df.withColumn("score_col_used", F.when(use, "blended_score_p2").otherwise("momentum_score"))
    return XS.rank_in_date(df, "_s", n).drop("_s")


def composite_pick_score(df: DataFrame, alpha: str, momentum: str, aw: float = 0.5, mw: float = 0.5) -> DataFrame:
    """(aw rank(alpha) + mw rank(momentum)) / (aw + mw), ranks within the date."""
    if aw + mw <= 0:
        aw, mw = 1.0, 0.0
    r = XS.percentile_ranks(df.withColumn("_m", z0(F.col(momentum))), ["rd"], ["asset"], [alpha, "_m"], null_fill=None)
    score = (aw * F.col(f"{alpha}_rank") + mw * F.col("_m_rank")) / (aw + mw)
    return r.withColumn("composite_score", F.round(score, 12)).drop("_m", "_m_rank", f"{alpha}_rank")


def monthly_picks(panel: DataFrame, n: int = 20, penalty: float = 0.35, mcap_lo: float | None = None, mcap_hi: float | None = None, weighting: str = "capped", cap: float = 0.14, alpha: str = "p_pre_surge") -> DataFrame:
    """Veto, risk-adjusted alpha, size band, composite rank, top n, capped weights, governance cap, renormalise."""
    risk = z0(F.col("governance_risk_score"))
    df = EV.hard_veto_filter(panel).withColumn("adjusted_score", F.col(alpha) * (1 - penalty * risk))
    df = composite_pick_score(U.mcap_band(df, mcap_lo, mcap_hi), "adjusted_score", "ret_12_1m")
    top = XS.rank_in_date(df, "composite_score", n)
    w = P.weights(top, "equal" if weighting == "equal" else "score", "composite_score", keys=["rd"])
    if weighting == "capped":
        w = P.water_fill_cap(w, "weight", cap, ["rd"]).drop("weight").withColumnRenamed("capped_weight", "weight")
    w = w.withColumn("_c", EV.governance_weight_cap(risk, F.col("weight")))
    tot = F.sum("_c").over(XS.Window.partitionBy("rd"))
    return w.withColumn("weight", F.when(tot > 0, F.col("_c") / tot).otherwise(F.col("_c"))).drop("_c")
