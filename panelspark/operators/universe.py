"""Snapshot universes: listing history, listing age, liquidity, eligibility."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from panelspark.functions.rolling import rolling_mean, series
from panelspark.operators.asof import asof, asof_snapshot, newest_at
from panelspark.sources.files import materialize


def listing_history(snapshots: DataFrame) -> DataFrame:
    """First/last sighting, usual market and inferred listing and delisting dates per asset."""
    per_market = snapshots.groupBy("asset", "market").agg(
        F.count(F.lit(1)).alias("c"), F.min("snapshot_date").alias("a"), F.max("snapshot_date").alias("b")
    )
    span = snapshots.agg(F.min("snapshot_date").alias("lo"), F.max("snapshot_date").alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    hist = per_market.groupBy("asset").agg(
        F.sum("c").alias("n_appearances"), F.min("a").alias("first_seen_date"), F.max("b").alias("last_seen_date"),
        F.min_by("market", F.struct(-F.col("c"), F.col("market"))).alias("market"),
    )
    active = F.col("last_seen_date") == hi
    return hist.withColumns({
        "is_active_latest": active,
        "inferred_listing_date": F.col("first_seen_date"),
        "inferred_delisting_date": F.when(~active, F.col("last_seen_date")),
        "listing_date_is_lower_bound": F.col("first_seen_date") == lo,
    })


def listed_months(history: DataFrame, keys: DataFrame) -> DataFrame:
    """Whole listed months at rd (round half even); NULL where the listing date is unknown or only a bound."""
    h = history.select("asset", "inferred_listing_date", "listing_date_is_lower_bound")
    known = F.col("inferred_listing_date").isNotNull() & ~F.coalesce("listing_date_is_lower_bound", F.lit(True))
    months = F.bround(F.datediff("rd", "inferred_listing_date") / F.lit(30.4375), 0).cast("int")
    return keys.join(h, "asset", "left").select(
        *keys.columns, F.when(known, months).alias("listed_months"), known.alias("listing_date_known")
    )


def avg_trading_value(bars: DataFrame, keys: DataFrame, n: int = 60) -> DataFrame:
    """Mean traded value and its observation count over the last n bars at or before rd."""
    cols = ["avg_trading_value_60d", "days_observed"]
    stats = rolling_mean(bars.select("asset", "d", "value"), series("asset"), "value", n, *cols).drop("value")
    return asof(keys, newest_at(stats, keys, ["asset"], "d"), ["asset"], "rd", "d", cols)


def is_preferred(asset: Column) -> Column:
    return asset.rlike(r"^\d{5}[579]$")


def is_spac(name: Column) -> Column:
    return F.coalesce(name, F.lit("")).rlike("(?i)스팩|SPAC")


def is_reit(name: Column) -> Column:
    return F.coalesce(name, F.lit("")).rlike("(?i)리츠|REIT")


@dataclass(frozen=True)
class Eligibility:
    # Default thresholds.
    min_trading_value: float = 5e8
    min_market_cap: float = 5e10
    min_listed_months: int = 12
    exclude_preferred: bool = True
    exclude_spac: bool = True
    exclude_reits: bool = True


def apply_eligibility(df: DataFrame, cfg: Eligibility = Eligibility()) -> DataFrame:
    """First matching reason wins; missing numbers count as 0, so unknown listing age is excluded."""
    rules = [
        (cfg.exclude_preferred, is_preferred(F.col("asset")), "preferred"),
        (cfg.exclude_spac, is_spac(F.col("name")), "spac"),
        (cfg.exclude_reits, is_reit(F.col("name")), "reit"),
        (True, F.coalesce("avg_trading_value_60d", F.lit(0.0)) < cfg.min_trading_value, "low_trading_value"),
        (True, F.coalesce("market_cap", F.lit(0.0)) < cfg.min_market_cap, "low_market_cap"),
        (True, F.coalesce("listed_months", F.lit(0)) < cfg.min_listed_months, "too_new"),
    ]
    reason = F.coalesce(*[F.when(cond, F.lit(name)) for on, cond, name in rules if on], F.lit(""))
    return df.withColumn("exclude_reason", reason).withColumn("eligible", F.col("exclude_reason") == "")


def filter_market(df: DataFrame, markets: list[str]) -> DataFrame:
    wanted = [m.upper() for m in markets]
    return df if "ALL" in wanted else df.filter(F.upper("market").isin(wanted))


def mcap_band(df: DataFrame, lo: float | None = None, hi: float | None = None) -> DataFrame:
    m = F.coalesce("market_cap", F.lit(0.0))
    if lo is not None:
        df = df.filter(m >= lo)
    if hi is not None:
        df = df.filter(m <= hi)
    return df


def universe_panel(
    snapshots: DataFrame, bars: DataFrame, names: DataFrame, dates: DataFrame, cfg: Eligibility = Eligibility(), markets: list[str] = ["ALL"]
) -> DataFrame:
    """The whole (asset, rd) panel in one plan: as-of membership, liquidity, listing age, eligibility."""
    snap = materialize(filter_market(asof_snapshot(snapshots, dates), markets), "members")
    keys = snap.select("asset", "rd")
    out = (
        snap.join(avg_trading_value(bars, keys), ["asset", "rd"], "left")
        .join(listed_months(listing_history(snapshots), keys), ["asset", "rd"], "left")
        .join(names.select("asset", "name"), "asset", "left")
        .withColumn("name", F.coalesce("name", F.lit("")))
    )
    return apply_eligibility(out, cfg)
