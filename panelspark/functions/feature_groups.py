"""Feature-group whitelists and the value a disabled or empty group is filled with."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Columns of each feature group.
GROUPS: dict[str, list[str]] = {
    "momentum": ["ret_1m", "ret_3m", "ret_6m", "ret_12m", "ret_12_1m", "rs_kospi_3m", "rs_kospi_12m", "rs_kosdaq_3m", "rs_kosdaq_12m"],
    "fundamental": [
        "per", "pbr", "psr", "ev_ebitda", "roe", "roa", "operating_margin", "net_margin", "revenue_growth_yoy",
        "operating_income_growth_yoy", "debt_to_equity", "fcf_yield", "dividend_yield", "value_score", "quality_score", "turnaround_score",
    ],
    "events": [
        "disclosure_event_total_score", "event_treasury_buyback_score", "event_capital_increase_score", "event_bonus_issue_score",
        "event_treasury_sell_score", "event_convertible_bond_score", "event_warrant_bond_score", "event_insider_holdings_score",
        "event_major_holders_score", "event_merger_score", "event_spinoff_score", "event_capital_reduction_score",
    ],
    "flow": [
        "foreign_net_buy_5d_zscore", "foreign_net_buy_20d_zscore", "foreign_net_buy_60d_zscore", "inst_net_buy_5d_zscore",
        "inst_net_buy_20d_zscore", "inst_net_buy_60d_zscore", "individual_net_buy_20d_zscore", "foreign_holding_pct",
        "foreign_holding_change_20d", "foreign_buying_streak_days", "inst_buying_streak_days", "market_foreign_net_buy_20d_kospi",
        "market_foreign_net_buy_20d_kosdaq", "market_inst_net_buy_20d_kospi", "market_inst_net_buy_20d_kosdaq",
        "market_foreign_cumulative_60d", "foreign_inst_combined_zscore_20d",
    ],
    "governance": [
        "governance_risk_score", "governance_quality_score", "owner_dilution_risk_score", "treasury_sale_overhang_score",
        "related_party_leakage_score", "succession_risk_score", "minority_shareholder_discount_score", "spinoff_listing_risk_score",
        "capital_allocation_quality_score", "governance_watchlist_flag", "governance_hard_veto_flag",
    ],
    "derivatives": ["vkospi_level", "vkospi_zscore_60d", "vkospi_change_5d", "vkospi_above_25", "foreign_futures_net_oi", "foreign_futures_net_5d_change", "kospi200_basis_bp"],
    "macro": [
        "macro_bok_base_rate", "macro_bok_rate_change_60d", "macro_ktb_3y_yield", "macro_ktb_10y_yield", "macro_ktb_10y_3y_spread",
        "macro_usd_krw", "macro_usd_krw_zscore_60d", "macro_usd_krw_change_20d", "macro_kr_pmi", "macro_kr_pmi_diffusion",
        "macro_consumer_sentiment", "macro_business_sentiment", "macro_kr_industrial_prod", "macro_export_yoy", "macro_export_yoy_3m_avg",
        "macro_us_10y", "macro_us_2y", "macro_us_10y_2y_spread", "macro_dxy", "macro_dxy_zscore_60d", "macro_vix", "macro_wti_close", "macro_wti_zscore_60d",
    ],
    "technical": [
        "ma_5", "ma_20", "ma_50", "ma_60", "ma_150", "ma_200", "ma_stack_aligned", "dist_from_ma_50", "dist_from_ma_150", "dist_from_ma_200",
        "high_52w", "low_52w", "dist_from_52w_high", "dist_from_52w_low", "new_52w_high_flag", "volume_ma_50", "volume_zscore_50",
        "volume_dryup_pct", "rsi_14", "rsi_overbought", "rsi_oversold", "atr_14", "atr_pct", "bb_upper_20", "bb_lower_20", "bb_position",
        "vol_contraction", "stage_label", "trend_template_score", "trend_template_pass", "breakout_flag",
    ],
    "regime": [
        "vkospi_zscore_63d", "usd_krw_change_20d", "foreign_kospi_cumulative_5d", "bok_rate_change_60d", "kospi_above_ma200",
        "regime_label_kr", "regime_sleeve_multiplier_core", "regime_sleeve_multiplier_future", "regime_sleeve_multiplier_early",
    ],
}

_FLAGS = {"ma_stack_aligned", "new_52w_high_flag", "rsi_overbought", "rsi_oversold", "trend_template_pass", "breakout_flag", "vkospi_above_25", "kospi_above_ma200"}
_ZERO_GROUPS = {"momentum", "fundamental", "events", "governance"}


def default_of(group: str, col: str):
    """Column holding the fill value of a disabled group."""
    if col in ("stage_label", "regime_label_kr"):
        return F.lit("unknown")
    if col == "kospi_above_ma200":
        return F.lit(None).cast("boolean")
    if col in _FLAGS:
        return F.lit(False)
    if col.startswith("regime_sleeve_multiplier"):
        return F.lit(1.0)
    if col == "trend_template_score":
        return F.lit(0)
    return F.lit(0.0) if group in _ZERO_GROUPS else F.lit(None).cast("double")


def with_feature_group(df: DataFrame, group: str, enabled: bool = True) -> DataFrame:
    """Guarantee the group's schema: fill every column when disabled, only the missing ones when enabled."""
    fill = {c: default_of(group, c) for c in GROUPS[group] if not enabled or c not in df.columns}
    if group == "fundamental":
        for c in ("fundamentals_period_end", "fundamentals_rcept_dt"):
            if not enabled or c not in df.columns:
                fill[c] = F.lit(None).cast("date")
    return df.withColumns(fill) if fill else df
