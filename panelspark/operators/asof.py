"""Backward as-of joins: union both sides, one sort per asset, carry the last row forward.

Each partition holds at most one row per (asset, day) from either side, so its
length is bounded by the calendar even where one asset owns most raw facts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F


def asof(
    keys: DataFrame,
    facts: DataFrame,
    by: list[str],
    key_date: str,
    fact_date: str,
    cols: list[str],
    seen: str | None = None,
) -> DataFrame:
    """For every key row, the newest fact row with fact_date <= key_date in the same `by` group.

    All `cols` come from that one fact row (NULLs kept); NULL where none exists.
    `seen` names an output column for the date of the row used.
    """
    payload = F.struct(F.col(fact_date).alias("_fd"), *[F.col(c) for c in cols])
    left_cols = keys.columns
    left = keys.select(
        *left_cols, F.col(key_date).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(facts.select(payload).schema[0].dataType).alias("_p")
    )
    right = facts.filter(F.col(fact_date).isNotNull()).select(
        *[F.col(c) if c in by else F.lit(None).cast(keys.schema[c].dataType).alias(c) for c in left_cols],
        F.col(fact_date).alias("_t"),
        F.lit(0).alias("_side"),
        payload.alias("_p"),
    )
    w = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    filled = left.unionByName(right).withColumn("_p", F.last("_p", ignorenulls=True).over(w))
    out = filled.filter(F.col("_side") == 1)
    picked = [F.col(f"_p.{c}").alias(c) for c in cols]
    if seen:
        picked.append(F.col("_p._fd").alias(seen))
    return out.select(*left_cols, *picked)


def newest_at(facts: DataFrame, dates: DataFrame, by: list[str], fact_date: str) -> DataFrame:
    """The facts that are the newest of their group on some date (rd) of `dates`: all that an as-of pass over these dates can pick.

    Facts have one row a group and day. Which date comes next after a day is read from a calendar, which is broadcast, and the next
    fact from the window facts are computed in, so facts are thinned out before they are shuffled.
    """
    rds = dates.select("rd").distinct()
    ahead = rds.withColumn("_from", F.lag("rd").over(Window.partitionBy(F.lit(1)).orderBy("rd"))).filter(F.col("_from").isNotNull())
    days = ahead.select(F.explode(F.sequence(F.date_add("_from", 1), "rd")).alias(fact_date), F.col("rd").alias("_next_rd"))
    first = rds.agg(F.min("rd").alias("rd")).scalar()
    following = F.lead(fact_date).over(Window.partitionBy(*by).orderBy(fact_date))
    seen = facts.filter(F.col(fact_date).isNotNull()).withColumn("_next_fact", following).join(F.broadcast(days), fact_date, "left")
    due = F.coalesce(F.col("_next_rd"), F.when(F.col(fact_date) <= first, first))
    return seen.filter(due.isNotNull() & (F.col("_next_fact").isNull() | (due < F.col("_next_fact")))).select(*facts.columns)


def asof_with_lag(series_long: DataFrame, dates: DataFrame, lags: dict[str, int], default: int = 0) -> DataFrame:
    """Per-series as-of on knowledge time: last non-null obs with obs_date + lag <= rd, long form."""
    lag = F.create_map(*[F.lit(x) for kv in lags.items() for x in kv]) if lags else None
    days = F.coalesce(lag[F.col("series")], F.lit(default)) if lags else F.lit(default)
    facts = series_long.filter(F.col("value").isNotNull()).withColumn("known_at", F.date_add("obs_date", days))
    names = series_long.select("series").distinct()
    return asof(_series_dates(names, dates), facts, ["series"], "rd", "known_at", ["value", "obs_date"])


def _series_dates(names: DataFrame, dates: DataFrame) -> DataFrame:
    """(series, rd) for every series name: the dates travel as one array per name, then explode."""
    packed = dates.agg(F.array_sort(F.collect_set("rd")).alias("_rds"))
    return names.withColumn("_rds", packed.scalar()).select("series", F.explode("_rds").alias("rd"))


def asof_snapshot(snapshots: DataFrame, dates: DataFrame) -> DataFrame:
    """Newest whole snapshot at or before each date, then all of its rows; never a later one."""
    days = snapshots.select(F.col("snapshot_date").alias("sd")).distinct()
    one = F.lit(1).alias("_g")
    pick = asof(dates.select("rd", one), days.select("sd", one), ["_g"], "rd", "sd", ["sd"]).select(
        "rd", F.col("sd").alias("snapshot_date")
    )
    return pick.filter(F.col("snapshot_date").isNotNull()).join(snapshots, "snapshot_date")


def outer_align(panels: list[DataFrame], on: str = "d") -> DataFrame:
    """Full outer alignment of several date-keyed panels with distinct columns and a row a date each.

    The panels are stacked and every column is taken from the one panel that has it: one shuffle, combined map-side, whatever the number of panels.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), panels)
    return stacked.groupBy(on).agg(*[F.max(c).alias(c) for c in stacked.columns if c != on])


def ffill_daily(panel: DataFrame, cols: list[str], on: str = "d") -> DataFrame:
    """Reindex a market-level panel to every calendar day and carry the last value forward."""
    span = panel.agg(F.min(on).alias("a"), F.max(on).alias("b"))
    days = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias(on))
    w = Window.partitionBy(F.lit(1)).orderBy(on).rowsBetween(Window.unboundedPreceding, 0)
    return days.join(panel, on, "left").select(on, *[F.last(c, ignorenulls=True).over(w).alias(c) for c in cols])
