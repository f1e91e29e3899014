"""Macro and derivatives panels: one row per calendar day, market level, bounded by the calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from panelspark.functions.feature_groups import GROUPS
from panelspark.functions.rolling import roll_mean, rolling_z
from panelspark.operators.asof import asof

# Raw series to published column names.
RENAME = {
    "bok_base_rate": "macro_bok_base_rate", "ktb_3y_yield": "macro_ktb_3y_yield", "ktb_10y_yield": "macro_ktb_10y_yield",
    "usd_krw": "macro_usd_krw", "kr_pmi": "macro_kr_pmi", "consumer_sentiment": "macro_consumer_sentiment",
    "business_sentiment": "macro_business_sentiment", "kr_industrial_prod": "macro_kr_industrial_prod", "kr_export_yoy": "macro_export_yoy",
    "us_10y": "macro_us_10y", "us_2y": "macro_us_2y", "vix": "macro_vix", "dxy": "macro_dxy", "wti_close": "macro_wti_close",
}

# Publication lag in days; series not listed are known at once.
PUBLICATION_LAG = {
    "macro_kr_pmi": 1, "macro_kr_pmi_diffusion": 1, "macro_consumer_sentiment": 20, "macro_business_sentiment": 25,
    "macro_kr_industrial_prod": 30, "macro_export_yoy": 5, "macro_export_yoy_3m_avg": 5,
}

def day():
    return Window.partitionBy(F.lit(1)).orderBy("d")


def _change(c, n):
    return F.try_divide(c, F.lag(c, n).over(day())) - 1


def macro_signals(panel: DataFrame) -> DataFrame:
    """Rename the raw series and derive changes, spreads and z-scores; absent series give NULL columns."""
    df = panel.withColumnsRenamed(RENAME)
    missing = {c: F.lit(None).cast("double") for c in RENAME.values() if c not in df.columns}
    df = df.withColumns(missing) if missing else df
    c = F.col
    z = lambda x: rolling_z(c(x), day(), 60, 15)
    out = df.withColumns({
        "macro_bok_rate_change_60d": _change(c("macro_bok_base_rate"), 60),
        "macro_ktb_10y_3y_spread": c("macro_ktb_10y_yield") - c("macro_ktb_3y_yield"),
        "macro_us_10y_2y_spread": c("macro_us_10y") - c("macro_us_2y"),
        "macro_usd_krw_zscore_60d": z("macro_usd_krw"),
        "macro_usd_krw_change_20d": _change(c("macro_usd_krw"), 20),
        "macro_kr_pmi_diffusion": c("macro_kr_pmi") - 50,
        "macro_export_yoy_3m_avg": roll_mean(c("macro_export_yoy"), day(), 3, 2),
        "macro_dxy_zscore_60d": z("macro_dxy"),
        "macro_wti_zscore_60d": z("macro_wti_close"),
    })
    return out.select("d", *GROUPS["macro"])


def derivative_signals(panel: DataFrame) -> DataFrame:
    """(d, vkospi_level, foreign_futures_net_oi) -> level, z-score, change, alarm flag and open-interest change."""
    v, oi = F.col("vkospi_level"), F.col("foreign_futures_net_oi")
    return panel.withColumns({
        "vkospi_zscore_60d": rolling_z(v, day(), 60, 10),
        "vkospi_change_5d": _change(v, 5),
        "vkospi_above_25": F.coalesce(v > 25, F.lit(False)),
        "foreign_futures_net_5d_change": oi - F.lag(oi, 5).over(day()),
        "kospi200_basis_bp": F.lit(None).cast("double"),
    })


def asof_panel(panel: DataFrame, dates: DataFrame, cols: list[str]) -> DataFrame:
    """Last row at or before each date, all columns from that row."""
    g = F.lit(1).alias("_g")
    return asof(dates.select("rd", g), panel.select("*", g), ["_g"], "rd", "d", cols).drop("_g")


def asof_panel_lagged(panel: DataFrame, dates: DataFrame, cols: list[str], lags: dict[str, int] = PUBLICATION_LAG) -> DataFrame:
    """Per column, the last non-null value already published at rd; columns of equal lag share one pass."""
    out = dates.select("rd").distinct()
    for lag in sorted({lags.get(c, 0) for c in cols}):
        group = [c for c in cols if lags.get(c, 0) == lag]
        w = day().rowsBetween(Window.unboundedPreceding, 0)
        filled = panel.select(F.date_add("d", lag).alias("d"), *[F.last(c, ignorenulls=True).over(w).alias(c) for c in group])
        out = out.join(asof_panel(filled, dates, group), "rd")
    return out


def vkospi_at(panel: DataFrame, dates: DataFrame, default: float = 18.0) -> DataFrame:
    return asof_panel(panel, dates, ["vkospi_level"]).fillna(default, ["vkospi_level"])
