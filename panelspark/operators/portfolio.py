"""Weights, costs, period returns and metrics, for every strategy and date at once.

Selections are bounded: each (strategy, rd) holds the top N rows, so windows
over a selection stay small whatever the size of the universe behind it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.operators.asof import asof
from panelspark.sources.files import materialize

KEY = ["strategy", "rd"]


def weights(sel: DataFrame, method: Column | str, score: str = "score", power: float = 2.0, cap: float = 0.14, keys=KEY, out: str = "weight") -> DataFrame:
    """equal, score, score_power, capped (clip once, renormalise) or concentrated (rank^-power, clip, renormalise).

    `method` may be a column, so one plan can hold several methods.
    """
    m = F.lit(method) if isinstance(method, str) else method
    g = Window.partitionBy(*keys)
    s = F.greatest(F.coalesce(score, F.lit(0.0)), F.lit(0.0))
    raw = F.when(m == "score_power", F.pow(s, F.lit(power))).when(m.isin("score", "capped"), s).when(m == "concentrated", F.pow(F.col("rank"), F.lit(-power))).otherwise(F.lit(1.0))
    df = sel.withColumn("_raw", raw)
    tot = F.sum("_raw").over(g)
    df = df.withColumn("_w", F.when(tot > 0, F.col("_raw") / tot).otherwise(1.0 / F.count(F.lit(1)).over(g)))
    df = df.withColumn("_w", F.when(m.isin("capped", "concentrated"), F.least("_w", F.lit(cap))).otherwise(F.col("_w")))
    return df.withColumn(out, F.col("_w") / F.sum("_w").over(g)).drop("_raw", "_w")


def water_fill_cap(df: DataFrame, weight: str, cap: float, keys=KEY, tie: str = "asset", out: str = "capped_weight") -> DataFrame:
    """Cap weights and hand the excess to the rest pro rata until nothing exceeds the cap.

    Closed form: with weights in descending order, row r stays below the cap when
    w * (1 - (r-1) cap) / (remaining weight) <= cap; the rows before the first such row are capped.
    """
    order = Window.partitionBy(*keys).orderBy(F.col(weight).desc(), F.col(tie))
    g = Window.partitionBy(*keys)
    w = F.col(weight)
    df = df.withColumns({"_r": F.row_number().over(order), "_before": F.coalesce(F.sum(w).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "_tot": F.sum(w).over(g)})
    grown = w * (1 - (F.col("_r") - 1) * cap) / (F.col("_tot") - F.col("_before"))
    df = df.withColumn("_free", grown <= cap + 1e-12)
    df = df.withColumn("_k", F.coalesce(F.min(F.when(F.col("_free"), F.col("_r"))).over(g) - 1, F.count(F.lit(1)).over(g)))
    df = df.withColumn("_rest", F.max(F.when(F.col("_r") == F.col("_k") + 1, F.col("_tot") - F.col("_before"))).over(g))
    val = F.when(F.col("_r") <= F.col("_k"), F.lit(cap)).otherwise(w * (1 - F.col("_k") * cap) / F.col("_rest"))
    return df.withColumn(out, val).drop("_r", "_before", "_tot", "_free", "_k", "_rest")


# Basis points per side by market cap, brokerage fee, sales tax.
FEE_BP, TAX_BP = 1.5, 18.0


def cost_bp_per_side(mcap: Column) -> Column:
    return F.when(mcap >= 5e12, 5.0).when(mcap >= 1e12, 10.0).otherwise(20.0) + FEE_BP


def round_trip_bp(mcap: Column) -> Column:
    return 2 * cost_bp_per_side(mcap) + TAX_BP


def target_positions(sel: DataFrame, participation: float = 0.05) -> DataFrame:
    """Notional capped at a share of mean traded value, whole shares, realised weight.

    Needs weight, capital, price, avg_trading_value_60d; capital is an input, so there is no path dependence.
    """
    want = F.col("capital") * F.col("weight")
    limit = F.coalesce("avg_trading_value_60d", F.lit(0.0)) * participation
    df = sel.withColumns({"notional": F.least(want, limit), "liquidity_capped": want > limit})
    df = df.withColumn("shares", F.when(F.col("price") > 0, F.floor(F.col("notional") / F.col("price"))).otherwise(F.lit(0)))
    return df.withColumn("realised_weight", F.try_divide(F.col("shares") * F.col("price"), F.col("capital")))


def exposure_scale(dd: Column, vol: Column) -> dict[str, Column]:
    """Drawdown ladder and volatility cash floor; the smaller exposure wins."""
    ladder = F.when(dd <= -0.25, 0.40).when(dd <= -0.15, 0.65).when(dd <= -0.08, 0.85).otherwise(1.0)
    level = F.when(dd <= -0.25, 3).when(dd <= -0.15, 2).when(dd <= -0.08, 1).otherwise(0)
    v = F.coalesce(vol, F.lit(18.0))
    cash = F.when(v > 35, 0.5).when(v > 25, 0.3).otherwise(0.0)
    scale = F.least(ladder, 1.0 - cash)
    return {"sleeve_scale": scale, "cash_floor": 1.0 - scale, "dd_level": level, "vkospi_cash_floor": cash}


def two_sleeve_select(pool: DataFrame, n: int, pre: float, cont: float, a: str = "p_pre_entry", b: str = "p_continuation") -> DataFrame:
    """First sleeve by `a`, second by `b` among the names left over; both ranks are limited before the shuffle."""
    from panelspark.operators.xsection import rank_in_date

    n_a = max(1, round(n * pre / (pre + cont)))
    n_b = max(1, n - n_a)
    first = rank_in_date(pool, a, n_a, out="sleeve_rank")
    rest = pool.join(first.select("asset", "rd"), ["asset", "rd"], "left_anti")
    second = rank_in_date(rest, b, n_b, out="sleeve_rank")
    return first.withColumn("sleeve", F.lit("pre_entry")).unionByName(second.withColumn("sleeve", F.lit("continuation")))


def period_returns(sel: DataFrame, bars: DataFrame, periods: DataFrame) -> DataFrame:
    """Holding return of each selected (asset, rd) until the next rebalance date; a missing or zero start gives 0.

    The start and end of every holding are two targets of one as-of pass.
    """
    held = sel.join(periods.filter(F.col("rd_next").isNotNull()), "rd")
    need = held.select("asset", "rd", F.explode(F.array(F.col("rd"), F.col("rd_next"))).alias("_t0")).distinct()
    got = asof(need, bars, ["asset"], "_t0", "d", ["close"]).groupBy("asset", "rd").agg(
        F.min_by("close", "_t0").alias("_c0"), F.max_by("close", "_t0").alias("_c1"), F.count("close").alias("_n"))
    ret = F.when((F.col("_n") == 2) & (F.col("_c0") > 0), F.col("_c1") / F.col("_c0") - 1).otherwise(0.0)
    return held.join(got, ["asset", "rd"], "left").withColumn("period_return", F.coalesce(ret, F.lit(0.0))).drop("_c0", "_c1", "_n")


def weight_turnover(sel: DataFrame, periods: DataFrame) -> DataFrame:
    """Half the sum of absolute weight changes per (strategy, rd); from cash at the first date.

    New weights count +w at rd and -w at the next date, so one aggregation replaces a full outer join.
    """
    now = sel.select("strategy", "rd", "asset", F.col("weight").alias("w"))
    later = sel.join(periods, "rd").filter(F.col("rd_next").isNotNull()).select("strategy", F.col("rd_next").alias("rd"), "asset", (-F.col("weight")).alias("w"))
    diff = now.unionByName(later).groupBy("strategy", "rd", "asset").agg(F.sum("w").alias("w"))
    return diff.groupBy("strategy", "rd").agg((F.sum(F.abs("w")) / 2).alias("turnover"))


def name_turnover(sel: DataFrame, periods: DataFrame) -> DataFrame:
    """Size of the symmetric difference of consecutive holdings / (2 N); 1 at the first date."""
    now = sel.select("strategy", "rd", "asset", F.lit(1).alias("w"))
    later = sel.join(periods, "rd").filter(F.col("rd_next").isNotNull()).select("strategy", F.col("rd_next").alias("rd"), "asset", F.lit(-1).alias("w"))
    diff = now.unionByName(later).groupBy("strategy", "rd", "asset").agg(F.sum("w").alias("w"), F.count_if(F.col("w") < 0).alias("o"))
    per = diff.groupBy("strategy", "rd").agg(F.sum(F.abs("w")).alias("sd"), F.sum("o").alias("old"))
    n = sel.groupBy("strategy", "rd").agg(F.count(F.lit(1)).alias("n"))
    return n.join(per, KEY).select(*KEY, F.when(F.col("old") == 0, 1.0).otherwise(F.col("sd") / (2 * F.col("n"))).alias("name_turnover"))


def membership_change(panel: DataFrame, periods: DataFrame) -> DataFrame:
    """Jaccard distance between the member sets of consecutive dates, per later date."""
    now = panel.select("rd", "asset", F.lit(1).alias("cur"), F.lit(0).alias("old"))
    prev = panel.join(periods.filter(F.col("rd_next").isNotNull()), "rd").select(F.col("rd_next").alias("rd"), "asset", F.lit(0).alias("cur"), F.lit(1).alias("old"))
    per = now.unionByName(prev).groupBy("rd", "asset").agg(F.max("cur").alias("cur"), F.max("old").alias("old"))
    agg = per.groupBy("rd").agg(F.sum(F.col("cur") * F.col("old")).alias("both"), F.count(F.lit(1)).alias("any"), F.sum("old").alias("n_old"))
    return agg.filter(F.col("n_old") > 0).select("rd", (1 - F.col("both") / F.col("any")).alias("change"))


def backtest_periods(sel: DataFrame, bars: DataFrame, periods: DataFrame, cost: Column | float = 0.0031) -> DataFrame:
    """One row per (strategy, rd): gross, turnover, cost, net. `sel` carries weight (and cost_rate if cost is a column)."""
    sel = materialize(sel, "selection")
    rets = period_returns(sel, bars, periods)
    rate = cost if isinstance(cost, Column) else F.lit(cost)
    gross = rets.groupBy("strategy", "rd", "rd_next").agg(
        F.sum(F.col("weight") * F.col("period_return")).alias("gross_return"), F.count(F.lit(1)).alias("n_holdings"), F.max(rate).alias("_rate"))
    out = gross.join(weight_turnover(sel, periods), KEY)
    out = out.withColumn("cost", F.col("turnover") * F.col("_rate")).drop("_rate")
    return out.withColumn("net_return", F.col("gross_return") - F.col("cost"))


def running_drawdown(df: DataFrame, equity: Column, keys: list[str], order: str = "rd", out: str = "drawdown") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_eq", equity)
    return df.withColumn(out, F.col("_eq") / F.max("_eq").over(w) - 1).drop("_eq")


def equity_curve(periods: DataFrame, ret: str = "net_return") -> DataFrame:
    w = Window.partitionBy("strategy").orderBy("rd").rowsBetween(Window.unboundedPreceding, 0)
    return periods.withColumn("cum_return", F.exp(F.sum(F.log1p(ret)).over(w)))


def portfolio_metrics(periods: DataFrame, per_year: int = 12) -> DataFrame:
    """One row per strategy from its period rows; strategies are just another key."""
    df = running_drawdown(equity_curve(periods), F.col("cum_return"), ["strategy"])
    n, r = F.count(F.lit(1)), F.col("net_return")
    m = df.groupBy("strategy").agg(
        n.alias("rebalance_count"), F.exp(F.sum(F.log1p(r))).alias("final_cum_return"), F.avg(r).alias("_mu"), F.stddev_samp(r).alias("_sd"),
        F.least(F.min("drawdown"), F.lit(0.0)).alias("max_dd"), F.avg("turnover").alias("avg_turnover"), F.sum("cost").alias("total_cost_drag"),
        F.avg((r > 0).cast("double")).alias("beat_month_ratio"), F.avg("n_holdings").alias("n_holdings_avg"), F.min("rd").alias("start"), F.max("rd_next").alias("end"),
    )
    years = F.col("rebalance_count") / float(per_year)
    return m.withColumns({
        "strategy_cagr": F.when(F.col("final_cum_return") > 0, F.pow("final_cum_return", 1.0 / years) - 1).otherwise(-1.0),
        "sharpe": F.when(F.col("_sd") > 1e-12, F.col("_mu") / F.col("_sd") * F.sqrt(F.lit(float(per_year)))).otherwise(0.0),
    }).drop("_mu", "_sd")


def with_benchmark(metrics: DataFrame, index: DataFrame, per_year: int = 12) -> DataFrame:
    """Index growth rate over each strategy's own window, and the excess. Few strategies join a short index series."""
    one = metrics.select("strategy", F.explode(F.array(F.struct(F.lit(0).alias("i"), F.col("start").alias("t")), F.struct(F.lit(1).alias("i"), F.col("end").alias("t")))).alias("e"))
    keys = one.select("strategy", F.col("e.i").alias("i"), F.col("e.t").alias("t"), F.lit(1).alias("g"))
    first = index.select(F.col("d"), "close", F.lit(1).alias("g"))
    got = asof(keys, first, ["g"], "t", "d", ["close"]).groupBy("strategy").agg(
        F.max(F.when(F.col("i") == 0, F.col("close"))).alias("_b0"), F.max(F.when(F.col("i") == 1, F.col("close"))).alias("_b1"))
    out = metrics.join(got, "strategy", "left")
    cagr = F.when(F.col("_b0") > 0, F.pow(F.col("_b1") / F.col("_b0"), per_year / F.col("rebalance_count")) - 1).otherwise(0.0)
    return out.withColumn("benchmark_cagr", F.coalesce(cagr, F.lit(0.0))).withColumn("excess_cagr", F.col("strategy_cagr") - F.col("benchmark_cagr")).drop("_b0", "_b1")


def verdict(excess: Column) -> Column:
    return F.when(excess >= 0.03, "SHIP").when(excess >= 0, "PARTIAL").otherwise("REGRESS")


def trade_list(positions: DataFrame, periods: DataFrame) -> DataFrame:
    """Share changes between consecutive target positions with the side's cost: (strategy, rd, asset, side, shares, notional, cost)."""
    cols = ["strategy", "rd", "asset", "shares", "price", "market_cap"]
    positions = materialize(positions, "positions")
    now = positions.select(*cols, F.lit(1).alias("sgn"))
    moved = positions.join(periods.filter(F.col("rd_next").isNotNull()), "rd").select("strategy", F.col("rd_next").alias("rd"), "asset", "shares", "price", "market_cap", F.lit(-1).alias("sgn"))
    j = now.unionByName(moved).groupBy("strategy", "rd", "asset").agg(
        F.sum(F.col("shares") * F.col("sgn")).alias("delta"), F.max_by("price", "sgn").alias("price"), F.max_by("market_cap", "sgn").alias("market_cap"))
    side = cost_bp_per_side(F.col("market_cap"))
    bp = F.when(F.col("delta") < 0, side + TAX_BP).otherwise(side)
    notional = F.abs("delta") * F.col("price")
    return j.filter(F.col("delta") != 0).select(
        *KEY, "asset", F.when(F.col("delta") > 0, "BUY").otherwise("SELL").alias("side"), F.abs("delta").alias("shares"), notional.alias("notional"), (notional * bp / 1e4).alias("cost"))


class Variant(NamedTuple):
    """Switches of one variant; a drawdown breaker needs the equity path and belongs to the cash simulators, which are left out."""

    guard: bool = False  # volatility guard
    overlay: bool = False  # governance overlay
    penalty: float = 0.35
    sleeves: bool = False  # two sleeves


# Variants.
VARIANTS: dict[str, Variant] = {
    "B0_baseline": Variant(),
    "D1_survivorship_fix": Variant(),
    "D2_historical_mcap": Variant(),
    "D3_purged_walkforward": Variant(),
    "A1_pre_entry": Variant(),
    "A2_pre_plus_continuation": Variant(sleeves=True),
    "A3_technical_gate": Variant(sleeves=True),
    "A4_flow_confirmation": Variant(sleeves=True),
    "A5_with_governance": Variant(overlay=True, sleeves=True),
    "A6_full_with_regime": Variant(guard=True, overlay=True, sleeves=True),
    "G0_no_governance": Variant(guard=True),
    "G1_soft_penalty": Variant(guard=True, overlay=True),
    "G2_hard_veto_only": Variant(guard=True, overlay=True, penalty=0.0),
    "G3_weight_cap": Variant(guard=True, overlay=True),
    "G4_event_driven_combined": Variant(guard=True, overlay=True, penalty=0.50, sleeves=True),
}


def variant_selections(picks: DataFrame, n: int) -> DataFrame:
    """All variants over the same picks in one plan.

    picks: (asset, rd, p_pre_entry, p_continuation, governance_risk_score, governance_hard_veto_flag, vkospi_level).
    Each pick is exploded to the variants that may hold it; ranking, capping and exposure then run per variant.
    """
    from panelspark.operators.events import governance_weight_cap
    from panelspark.operators.xsection import rank_in_date

    rows = F.array(*[F.struct(F.lit(k).alias("strategy"), F.lit(v.guard).alias("guard"), F.lit(v.overlay).alias("overlay"), F.lit(v.penalty).alias("penalty"), F.lit(v.sleeves).alias("sleeves")) for k, v in VARIANTS.items()])
    picks = materialize(picks, "picks")
    df = picks.withColumn("_v", F.explode(rows)).select(*picks.columns, "_v.*")
    df = df.filter(~F.col("overlay") | (F.coalesce("governance_hard_veto_flag", F.lit(0.0)) < 0.5))
    risk = F.coalesce("governance_risk_score", F.lit(0.0))
    factor = F.when(F.col("overlay"), 1 - F.col("penalty") * risk).otherwise(1.0)
    df = df.withColumns({"_a": F.col("p_pre_entry") * factor, "_b": F.col("p_continuation") * factor})
    n_a = max(1, n // 2)
    first = rank_in_date(df, "_a", n, KEY, out="_r").filter(~F.col("sleeves") | (F.col("_r") <= n_a))
    rest = df.filter("sleeves").join(first.select(*KEY, "asset"), [*KEY, "asset"], "left_anti")
    second = rank_in_date(rest, "_b", n - n_a, KEY, out="_r")
    sel = first.unionByName(second)
    g = Window.partitionBy(*KEY)
    sel = sel.withColumn("_w", F.lit(1.0) / F.count(F.lit(1)).over(g))
    sel = sel.withColumn("_w", F.when(F.col("overlay"), governance_weight_cap(risk, F.col("_w"))).otherwise(F.col("_w")))
    tot = F.sum("_w").over(g)
    sel = sel.withColumn("weight", F.when(tot > 0, F.col("_w") / tot).otherwise(F.col("_w")))
    scale = F.when(F.col("guard"), exposure_scale(F.lit(0.0), F.col("vkospi_level"))["sleeve_scale"]).otherwise(1.0)
    return sel.withColumn("weight", F.col("weight") * scale).select(*KEY, "asset", "weight")


# Feature-group combinations and the groups each one switches on.
COMBINATIONS: dict[str, set[str]] = {
    "P0_only": set(), "P0+P1": {"fundamental"}, "P0+P2_events": {"events"}, "P0+P2.5_flow": {"flow"}, "P0+P3_technical": {"technical"},
    "P0+P1+P2+P3": {"fundamental", "events", "flow", "technical"},
}


def combination_scores(panel: DataFrame) -> DataFrame:
    """Blended score per feature-group combination: weights of the switched-off groups drop out of the blend.

    panel: (asset, rd, momentum_score, value_score, quality_score, turnaround_score, disclosure_event_total_score).
    """
    rows = F.array(*[F.struct(F.lit(k).alias("strategy"), F.lit("fundamental" in v).alias("p1"), F.lit("events" in v).alias("p2")) for k, v in COMBINATIONS.items()])
    df = panel.withColumn("_c", F.explode(rows)).select(*panel.columns, "_c.*")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    fund = lambda a, b, c: a * z("value_score") + b * z("quality_score") + c * z("turnaround_score")
    p1 = (0.40 * z("momentum_score") + fund(0.25, 0.25, 0.10)) / 1.0
    full = 0.30 * z("momentum_score") + fund(0.20, 0.20, 0.10) + 0.20 * z("disclosure_event_total_score")
    ev_only = (0.30 * z("momentum_score") + 0.20 * z("disclosure_event_total_score")) / 0.5
    score = F.when(F.col("p1") & F.col("p2"), full).when(F.col("p1"), p1).when(F.col("p2"), ev_only).otherwise(z("momentum_score"))
    return df.withColumn("score", score)


def validation_suite(panel: DataFrame, signals: list[str], periods: DataFrame) -> DataFrame:
    """One row of member counts, null rates and membership change with pass flags."""
    counts = panel.groupBy("rd").agg(F.count(F.lit(1)).alias("n"))
    a = counts.agg(F.min("n").alias("members_min"), F.max("n").alias("members_max"), F.avg("n").alias("members_mean"))
    b = panel.agg(F.greatest(*[F.avg(F.col(c).isNull().cast("double")) for c in signals], F.lit(0.0)).alias("max_null_rate"))
    c = membership_change(panel, periods).agg(F.max("change").alias("change_max"), F.avg("change").alias("change_mean"))
    one = F.lit(1).alias("_1")
    out = a.select("*", one).join(b.select("*", one), "_1").join(c.select("*", one), "_1").drop("_1")
    out = out.withColumns({"members_pass": F.col("members_min") >= 200, "nulls_pass": F.col("max_null_rate") < 0.30, "change_pass": F.col("change_max") < 0.50})
    return out.withColumn("all_pass", F.col("members_pass") & F.col("nulls_pass") & F.col("change_pass"))
