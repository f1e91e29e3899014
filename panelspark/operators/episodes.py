"""Episode mining: multi-bagger runs and price dips.

Candidates come from window frames over all assets at once. Only the greedy
choice among overlapping candidates is sequential; it folds over the short
ordered list of one asset's candidates (bounded by the calendar).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from panelspark.functions.rolling import rolling_extremes, series
from panelspark.operators.around import around
from panelspark.operators.asof import asof


def multibagger_candidates(prices: DataFrame, threshold: float = 3.0, window: int = 24) -> DataFrame:
    """Month-end (asset, rd, close) -> rows whose best close over the next `window` months gains `threshold`."""
    w, full = series("asset", order="rd"), Window.partitionBy("asset")
    df = prices.filter(F.col("close").isNotNull()).withColumn("t", F.row_number().over(w))
    best = F.max(F.struct(F.col("close").alias("p"), (-F.col("t")).alias("nt"), F.col("rd").alias("rd"))).over(w.rowsBetween(1, window))
    df = df.withColumns({"_n": F.count(F.lit(1)).over(full), "_b": best})
    gain = F.col("_b.p") / F.col("close") - 1
    return df.filter((F.col("_n") >= window + 1) & (F.col("close") > 0) & (gain >= threshold)).select(
        "asset", F.col("rd").alias("entry_date"), F.col("close").alias("entry_price"), F.col("_b.rd").alias("peak_date"),
        F.col("_b.p").alias("peak_price"), gain.alias("max_return"), (-F.col("_b.nt") - F.col("t")).alias("months_to_peak"),
    )


def greedy_non_overlapping(cands: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Keep the earliest candidate, then each next one that starts after the last kept end."""
    rest = [c for c in cands.columns if c not in (key, start, end)]
    item = F.struct(F.col(start).alias("s"), F.col(end).alias("e"), *rest)
    lists = cands.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_c"))
    kept = F.aggregate(
        F.slice("_c", 2, 1 << 30), F.slice("_c", 1, 1),
        lambda acc, x: F.when(x["s"] > F.element_at(acc, -1)["e"], F.concat(acc, F.array(x))).otherwise(acc),
    )
    return lists.select(key, F.explode(kept).alias("_x")).select(key, F.col("_x.s").alias(start), F.col("_x.e").alias(end), *[F.col(f"_x.{c}").alias(c) for c in rest])


def multibagger_episodes(prices: DataFrame, threshold: float = 3.0, window: int = 24) -> DataFrame:
    return greedy_non_overlapping(multibagger_candidates(prices, threshold, window), "asset", "entry_date", "peak_date")


def surge_start(eps: DataFrame, prices: DataFrame, breakout: float = 0.20) -> DataFrame:
    """First month after entry, up to the peak, at +20 % (else at +10 %, half the breakout); accumulation in months."""
    p = prices.select("asset", F.col("rd").alias("_d"), F.col("close").alias("_p"))
    j = eps.join(p, (eps.asset == p.asset) & (p._d > eps.entry_date) & (p._d <= eps.peak_date)).drop(p.asset)
    first = j.groupBy("asset", "entry_date").agg(
        F.min(F.when(F.col("_p") >= F.col("entry_price") * (1 + breakout), F.col("_d"))).alias("_a"),
        F.min(F.when(F.col("_p") >= F.col("entry_price") * (1 + breakout / 2), F.col("_d"))).alias("_h"),
    )
    out = eps.join(first, ["asset", "entry_date"], "left").withColumn("surge_start_date", F.coalesce("_a", "_h")).drop("_a", "_h")
    return out.withColumn("accumulation_months", F.datediff("surge_start_date", "entry_date") / F.lit(30.4375))


def quality_filter(eps: DataFrame, mcap: DataFrame, floor: float = 5e11) -> DataFrame:
    m = mcap.select("asset", F.col("snapshot_date").alias("entry_date"), F.col("market_cap").alias("mcap_at_entry"))
    return eps.join(m, ["asset", "entry_date"], "left").withColumn("quality_pass", F.coalesce(F.col("mcap_at_entry") >= floor, F.lit(False)))


def episode_panel(prices: DataFrame, mcap: DataFrame, threshold: float = 3.0, window: int = 24, breakout: float = 0.20) -> DataFrame:
    return quality_filter(surge_start(multibagger_episodes(prices, threshold, window), prices, breakout), mcap)


def episode_stats(eps: DataFrame) -> DataFrame:
    """Counts of all episodes, and exact quantiles of those that pass quality, as one row."""
    from panelspark.operators.ordered import exact_quantiles

    one = F.lit(1).alias("_g")
    good = F.col("quality_pass")
    base = eps.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("asset").alias("assets"), F.count_if(good).alias("quality"),
        F.count_distinct(F.when(good, F.col("asset"))).alias("quality_assets"), F.max(F.when(good, F.col("max_return"))).alias("return_max"),
    ).withColumn("_g", F.lit(1))
    passing = eps.filter(good)
    q = exact_quantiles(passing.select("max_return", one), ["_g"], "max_return", {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}).drop("n")
    m = exact_quantiles(passing.select(F.col("months_to_peak").cast("double").alias("months_to_peak"), one), ["_g"], "months_to_peak", {"median_months": 0.5}).drop("n")
    c = exact_quantiles(passing.select("mcap_at_entry", one), ["_g"], "mcap_at_entry", {"mcap_median": 0.5, "mcap_p95": 0.95}).drop("n")
    return base.join(q, "_g", "left").join(m, "_g", "left").join(c, "_g", "left").drop("_g")


def episodes_by_year(eps: DataFrame) -> DataFrame:
    return eps.filter("quality_pass").groupBy(F.year("entry_date").alias("entry_year")).agg(F.count(F.lit(1)).alias("n"))


def top_episodes(eps: DataFrame, k: int = 30) -> DataFrame:
    """The k largest gains; ties by asset and entry."""
    return eps.orderBy(F.col("max_return").desc(), F.concat("asset", F.col("entry_date").cast("string"))).limit(k)


def cohort_crosstab(eps: DataFrame) -> DataFrame:
    """(entry year, peak year, n) for every pair of years that occurs."""
    return eps.groupBy(F.year("entry_date").alias("entry_year"), F.year("peak_date").alias("peak_year")).agg(F.count(F.lit(1)).alias("n"))


# dips ------------------------------------------------------------------------------------------
# Default triggers, look-back, outcome window and barriers.
DIP = {"dip_1d": -0.05, "dip_5d": -0.10, "lookback": 30, "window": 60, "upper": 0.05, "lower": 0.20, "min_mcap": 5e11}


def dip_candidates(bars: DataFrame, dip_1d=DIP["dip_1d"], dip_5d=DIP["dip_5d"], lookback=DIP["lookback"], window=DIP["window"], upper=DIP["upper"], lower=DIP["lower"]) -> DataFrame:
    """Every triggered bar with its frozen peak and its triple-barrier outcome over the next rows.

    Bars are looked at one by one for the trigger alone; the rows around a dip are gathered for triggered bars.
    """
    w, full = series("asset"), Window.partitionBy("asset")
    c = F.col("close")
    rows = bars.select("asset", "d", "close").withColumn("t", F.row_number().over(w).cast("bigint") - 1)
    df = rolling_extremes(rows, w, {"_hi": ("close", "max")}, lookback).withColumns({
        "_n": F.count(F.lit(1)).over(full), "_prev": F.lag("close").over(w), "_hi5": F.max("close").over(w.rowsBetween(-4, 0)),
        "peak_close": F.lag("_hi").over(w),
    })
    hit = (c / F.col("_prev") - 1 <= dip_1d) | (c / F.col("_hi5") - 1 <= dip_5d)
    ok = (F.col("_n") >= lookback + window + 5) & (F.col("t") >= lookback) & (F.col("t") < F.col("_n") - 1) & (F.col("_prev") > 0)
    keys = df.filter(ok & hit).withColumn("_last", F.least(F.lit(window), F.col("_n") - 1 - F.col("t"))).select("asset", "t", "d", "close", "peak_close", "_last")
    o, x = F.col("o"), F.col("_close")
    # only numbers and dates are aggregated: such buffers are updated in place
    df = around(keys, rows, "asset", "t", -lookback, window, ["close", "d"]).groupBy(*keys.columns).agg(
        F.min(F.when((o < 0) & (x == F.col("peak_close")), F.col("_d"))).alias("peak_date"), F.max(F.when(o == F.col("_last"), x)).alias("recovery_close"),
        F.min(F.when((o > 0) & (x >= F.col("peak_close") * (1 - upper)), o)).alias("_up"), F.min(F.when((o > 0) & (x <= c * (1 - lower)), o)).alias("_dn"),
    )
    won = F.col("_up").isNotNull() & (F.col("_dn").isNull() | (F.col("_up") <= F.col("_dn")))
    lost = F.col("_dn").isNotNull() & ~won
    return df.select(
        "asset", "t", F.col("d").alias("dip_date"), "peak_date", c.alias("dip_low_close"), "peak_close", (c / F.col("peak_close") - 1).alias("drawdown_pct"),
        "recovery_close", F.when(won, 1).when(lost, 0).alias("label"),
        F.when(won, f"recovery_{int(upper * 100)}pct_to_peak").when(lost, f"further_drawdown_{int(lower * 100)}pct").otherwise("ambiguous").alias("label_reason"),
        F.when(won, F.col("_up")).when(lost, F.col("_dn")).alias("days_to_label"), won.alias("recovered"),
    )


def dip_episodes(bars: DataFrame, mcap: DataFrame, min_mcap: float = DIP["min_mcap"], **params) -> DataFrame:
    """Dips kept after the cool-down: 15 rows or the time to the label after an event, 5 after a size reject."""
    lookback, window = params.get("lookback", DIP["lookback"]), params.get("window", DIP["window"])
    cands = asof(dip_candidates(bars, **params), mcap, ["asset"], "dip_date", "snapshot_date", ["market_cap"])
    cands = cands.withColumnRenamed("market_cap", "market_cap_at_dip")
    rest = [c for c in cands.columns if c not in ("asset", "t")]
    lists = cands.groupBy("asset").agg(F.array_sort(F.collect_list(F.struct("t", *rest))).alias("_c"))
    ok = lambda x: F.coalesce(x["market_cap_at_dip"] >= min_mcap, F.lit(False))
    pause = lambda x: F.greatest(F.lit(lookback // 2).cast("bigint"), F.coalesce(x["days_to_label"], F.lit(window).cast("bigint")))
    start = F.struct(F.lit(-1).cast("bigint").alias("until"), F.slice("_c", 1, 0).alias("kept"))

    def step(acc, x):
        nxt = F.when(ok(x), F.struct((x["t"] + pause(x)).cast("bigint").alias("until"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(
            F.struct((x["t"] + 5).cast("bigint").alias("until"), acc["kept"].alias("kept")))
        return F.when(x["t"] <= acc["until"], acc).otherwise(nxt)

    kept = F.aggregate("_c", start, step, lambda acc: acc["kept"])
    return lists.select("asset", F.explode(kept).alias("_x")).select("asset", *[F.col(f"_x.{c}").alias(c) for c in ("t", *rest)])


# strategies over episodes ----------------------------------------------------------------------
def episode_strategy_returns(eps: DataFrame, p: str, hold: float = 0.65, sell: float = 0.40, stop: float = -0.08, cost_bp: float = 31.0) -> DataFrame:
    """(episode key columns, strategy, ret) for hold, stop, classifier and hybrid rules."""
    r = F.greatest(F.lit(-0.5), F.least(F.lit(5.0), F.col("recovery_close") / F.col("dip_low_close") - 1))
    dd, cost, prob = F.coalesce("drawdown_pct", F.lit(0.0)), F.lit(cost_bp / 10000), F.col(p)
    cls = F.when(prob >= hold, r).when(prob < sell, dd - cost).otherwise(0.5 * (dd - cost) + 0.5 * r)
    named = {"naive_hold": r, "naive_stop": F.when(r >= stop, r).otherwise(F.lit(stop)), "classifier": cls, "hybrid": F.when(dd <= stop, F.lit(stop) - cost).otherwise(cls)}
    return eps.withColumns(named).unpivot(["asset", "dip_date", "label"], list(named), "strategy", "ret")


def strategy_summary(rets: DataFrame) -> DataFrame:
    """n, mean, median, hit rate, 5 % quantile and sample deviation per strategy, quantiles exact at any size."""
    from panelspark.operators.ordered import exact_quantiles

    r = F.col("ret")
    base = rets.groupBy("strategy").agg(F.count(r).alias("n_episodes"), F.avg(r).alias("mean_return"), F.avg((r > 0).cast("double")).alias("hit_rate"),
                                        F.coalesce(F.stddev_samp(r), F.lit(0.0)).alias("stdev"), F.count("label").alias("n_labeled_used"))
    q = exact_quantiles(rets, ["strategy"], "ret", {"median_return": 0.5, "left_tail_5pct_loss": 0.05}).drop("n")
    return base.join(q, "strategy", "left")
