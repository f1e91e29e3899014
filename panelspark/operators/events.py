"""Disclosure event scores and governance risk over trailing windows.

Events are summed per (asset, day) first. Running totals per asset turn every
trailing window into the difference of two as-of look-ups, so one pass answers
all windows for all dates and no event is ever paired with a date. Amounts are
scaled decimals, which makes the differences exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from panelspark.functions.rolling import running, series
from panelspark.functions.scalars import clip, parse_number
from panelspark.operators.asof import asof

# Category -> (weight, mode, share of market cap at which the weight is fully applied).
CATALOG: dict[str, tuple[float, str, float | None]] = {
    "treasury_buyback": (0.50, "amount", 0.02),
    "capital_increase": (-0.40, "dilution", 0.05),
    "bonus_issue": (0.30, "binary", None),
    "treasury_sell": (-0.30, "amount", 0.02),
    "convertible_bond": (-0.20, "amount", 0.10),
    "warrant_bond": (-0.20, "amount", 0.10),
    "insider_holdings": (0.30, "insider", 0.005),
    "major_holders": (0.25, "stake", None),
    "merger": (0.0, "binary", None),
    "spinoff": (-0.15, "binary", None),
    "capital_reduction": (-0.40, "binary", None),
}


#: Amounts, prices, quantities and stake changes keep four decimals; a product of two of them has eight and sums exactly.
EXACT = "decimal(18,4)"


def daily_totals(events: DataFrame) -> DataFrame:
    """(asset, d) with one exact measure per category: amounts, signed amounts, counts and flags.

    Amounts may be numbers or texts such as '1,234'; what is no number counts as 0. Stake changes are percentage points.
    """
    cat = F.col("event_category")
    has = lambda c: c in events.columns
    kinds = dict(events.dtypes)
    number = lambda c: parse_number(F.col(c)) if kinds[c] == "string" else F.col(c)
    z = lambda c: F.coalesce(number(c).try_cast(EXACT), F.lit(0).cast(EXACT)) if has(c) else F.lit(0).cast(EXACT)
    qty, price, delta = z("nstk_ostk_qy"), z("bdis_pric"), z("aft_stkqy") - z("bsis_stkqy")
    if has("trade_uv"):
        insider = delta.cast(EXACT) * z("trade_uv")
    else:
        insider = F.signum(delta.cast("double")).cast(EXACT) * F.abs(z("trade_amt"))
    stake = z("stkrt_irds")
    text = lambda c, pat: F.coalesce(F.col(c).rlike(pat), F.lit(False)).cast("bigint") if has(c) else None
    physical = text("div_mth", "물적")
    measure = {
        "a_treasury_buyback": ("treasury_buyback", z("aqpln_prc_ostk")), "a_treasury_sell": ("treasury_sell", z("dppln_prc_ostk")),
        "a_convertible_bond": ("convertible_bond", z("bd_fta")), "a_warrant_bond": ("warrant_bond", z("bd_fta")),
        "a_capital_increase": ("capital_increase", qty * price), "a_insider_holdings": ("insider_holdings", insider),
        "a_major_holders": ("major_holders", stake),
        "x_third_party": ("capital_increase", text("ic_mthn", "제3자|3자배정") if has("ic_mthn") else F.lit(0)),
        "x_physical": ("spinoff", physical if physical is not None else F.lit(1)),
    }
    aggs = [F.sum(F.when(cat == c, v).otherwise(0)).alias(n) for n, (c, v) in measure.items()]
    aggs += [F.count_if(cat == c).alias(f"n_{c}") for c in CATALOG]
    return events.filter(F.col("rcept_dt").isNotNull()).groupBy("asset", F.col("rcept_dt").alias("d")).agg(*aggs)


def window_totals(events: DataFrame, keys: DataFrame, windows: dict[str, Column]) -> DataFrame:
    """For each key the totals of every measure over each window, as structs named after the windows.

    `windows` gives the last day BEFORE each window; every window ends at rd.
    """
    daily = daily_totals(events)
    measures = [c for c in daily.columns if c not in ("asset", "d")]
    w = running(series("asset"))
    totals = daily.select("asset", "d", *[F.sum(m).over(w).alias(m) for m in measures])
    names = ["_end", *windows]
    ends = F.array(*[F.struct(F.lit(n).alias("n"), e.alias("t")) for n, e in zip(names, [F.col("rd"), *windows.values()])])
    targets = keys.select("asset", "rd", F.explode(ends).alias("_e")).select("asset", "rd", F.col("_e.n").alias("_n"), F.col("_e.t").alias("_t0"))
    got = asof(targets, totals, ["asset"], "_t0", "d", measures)
    at = lambda n, m: F.coalesce(F.max(F.when(F.col("_n") == n, F.col(m))), F.lit(0))
    # Totals of signed measures may fall, so look each target up by name instead of taking differences of maxima.
    return got.groupBy("asset", "rd").agg(
        *[F.struct(*[(at("_end", m) - at(n, m)).alias(m) for m in measures]).alias(n) for n in windows]
    )


def _share(amount: Column, mcap: Column, full: float) -> Column:
    return F.when((amount > 0) & (mcap > 0), F.least(F.lit(1.0), amount / mcap / full)).otherwise(0.0)


def event_scores(events: DataFrame, universe: DataFrame, days: int = 90) -> DataFrame:
    """Eleven signed category scores and their sum for every (asset, rd, market_cap) row of the universe."""
    tot = window_totals(events, universe.select("asset", "rd"), {"w": F.date_sub("rd", days + 1)})
    df = universe.join(tot, ["asset", "rd"], "left")
    m = F.coalesce("market_cap", F.lit(0.0))
    priced = "nstk_ostk_qy" in events.columns and "bdis_pric" in events.columns
    cols = {}
    for c, (wt, mode, full) in CATALOG.items():
        n, a = F.coalesce(F.col(f"w.n_{c}"), F.lit(0)), F.coalesce(F.col(f"w.a_{c}").cast("double"), F.lit(0.0)) if mode not in ("binary",) else None
        if mode == "binary":
            s = F.when(n > 0, F.lit(wt)).otherwise(0.0)
        elif mode == "dilution" and not priced:
            s = F.when((n > 0) & (m > 0), F.lit(wt * 0.5)).otherwise(0.0)
        elif mode in ("amount", "dilution"):
            s = F.lit(wt) * _share(a, m, full)
        elif mode == "insider":
            s = F.when(m > 0, F.lit(wt) * clip(a / m / full, -1, 1)).otherwise(0.0)
        else:
            s = F.lit(wt) * clip(a, -1, 1)
        cols[f"event_{c}_score"] = s
    out = df.withColumns(cols)
    total = reduce(lambda x, y: x + y, [F.col(c) for c in cols])
    return out.withColumn("disclosure_event_total_score", total).drop("w")


# Look-back months per component and hard-veto thresholds.
LOOKBACK = {"m12": 12, "m18": 18, "m24": 24}
VETO = {"third_party": 0.10, "any": 0.20, "sale": 0.05}


def governance_inputs(events: DataFrame, universe: DataFrame) -> DataFrame:
    """universe + window totals over 12, 18 and 24 months (half-open at the start)."""
    wins = {n: F.add_months("rd", -m) for n, m in LOOKBACK.items()}
    return universe.join(window_totals(events, universe.select("asset", "rd"), wins), ["asset", "rd"], "left")


def governance_scores(events: DataFrame, universe: DataFrame) -> DataFrame:
    """Owner dilution, treasury overhang, spin-off, succession, quality; composite risk, watch-list and veto flags.

    universe has (asset, rd, market_cap, group_flag).
    """
    df = governance_inputs(events, universe)
    m = F.coalesce("market_cap", F.lit(0.0))
    v = lambda w, c: F.coalesce(F.col(f"{w}.{c}").cast("double"), F.lit(0.0))
    pct = lambda x: F.when(m > 0, x / m).otherwise(0.0)
    cap = lambda x: F.least(F.lit(1.0), x)
    flag = lambda c: c.cast("double")
    df = df.withColumns({
        "dilution_pct_12m": pct(v("m12", "a_capital_increase")),
        "cb_bw_burden_pct": pct(v("m12", "a_convertible_bond") + v("m12", "a_warrant_bond")),
        "third_party_allocation_flag": F.when((m > 0) & (v("m12", "x_third_party") > 0), 1.0).otherwise(0.0),
        "treasury_sale_pct_12m": pct(v("m12", "a_treasury_sell")),
        "physical_spinoff_active_flag": flag(v("m18", "x_physical") > 0),
        "capital_reduction_active_flag": flag(v("m18", "n_capital_reduction") > 0),
        "_buyback": pct(v("m12", "a_treasury_buyback")),
        "_base": 0.4 * cap(v("m24", "n_insider_holdings") / 30.0) + 0.2 * cap(v("m24", "n_major_holders") / 10.0),
        "_bonus": flag((m > 0) & (v("m12", "n_bonus_issue") > 0)),
        "_spin": flag(v("m18", "n_spinoff") > 0),
    })
    c = F.col
    df = df.withColumns({
        "owner_dilution_risk_score": cap(0.5 * cap(c("dilution_pct_12m") / 0.10) + 0.3 * cap(c("cb_bw_burden_pct") / 0.20) + 0.2 * c("third_party_allocation_flag")),
        "treasury_sale_overhang_score": cap(c("treasury_sale_pct_12m") / 0.05),
        "spinoff_listing_risk_score": F.when(c("physical_spinoff_active_flag") > 0, 0.7).otherwise(0.3 * c("_spin")),
        "succession_risk_score": F.when(F.coalesce("group_flag", F.lit(False)), cap(c("_base") * 1.5)).otherwise(c("_base")),
        "capital_allocation_quality_score": cap(0.6 * cap(c("_buyback") / 0.02) + 0.3 * c("_bonus")),
        "related_party_leakage_score": F.lit(0.0),
    })
    # a spin-off scores whole tenths: its share is exact in decimals, so sums on the edge of a tier stay on their side
    spinoff = (c("spinoff_listing_risk_score").cast("decimal(2,1)") * F.lit("0.20").cast("decimal(3,2)")).cast("double")
    df = df.withColumn("governance_risk_score", cap(
        0.30 * c("owner_dilution_risk_score") + 0.20 * c("treasury_sale_overhang_score") + spinoff
        + 0.15 * c("succession_risk_score") + 0.15 * c("capital_reduction_active_flag")))
    veto = (
        ((c("dilution_pct_12m") >= VETO["third_party"]) & (c("third_party_allocation_flag") > 0)) | (c("dilution_pct_12m") >= VETO["any"])
        | (c("treasury_sale_pct_12m") >= VETO["sale"]) | (c("capital_reduction_active_flag") > 0) | (c("physical_spinoff_active_flag") > 0)
    )
    watch = (c("governance_risk_score") >= 0.40) | (F.greatest("owner_dilution_risk_score", "treasury_sale_overhang_score", "spinoff_listing_risk_score") >= 0.60)
    return df.withColumns({
        "governance_quality_score": c("capital_allocation_quality_score"),
        "minority_shareholder_discount_score": F.greatest(F.lit(0.0), c("governance_risk_score") - c("capital_allocation_quality_score")),
        "governance_hard_veto_flag": flag(veto), "governance_watchlist_flag": flag(watch),
    }).drop("_buyback", "_base", "_bonus", "_spin", *LOOKBACK)


def hard_veto_filter(df: DataFrame) -> DataFrame:
    return df.filter(F.coalesce("governance_hard_veto_flag", F.lit(0.0)) < 0.5)


def governance_weight_cap(risk: Column, weight: Column) -> Column:
    """Risk-tiered weight cap."""
    return F.when(risk >= 0.80, F.lit(0.0)).when(risk >= 0.60, F.least(weight, F.lit(0.02))).when(risk >= 0.40, F.least(weight, F.lit(0.04))).otherwise(weight)
