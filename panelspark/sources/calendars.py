"""Trading calendars and rebalance grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def trading_days(index_bars: DataFrame) -> DataFrame:
    return index_bars.select("d").distinct()


def month_end_trading_days(cal: DataFrame) -> DataFrame:
    return cal.groupBy(F.trunc("d", "MM").alias("m")).agg(F.max("d").alias("rd")).select("rd")


def rebalance_grid(span: DataFrame, freq: str) -> DataFrame:
    """Dates between span.a and span.b: 'M' month ends, 'Q' quarter ends, or 'W-MON' .. 'W-FRI'."""
    days = span.select("a", "b", F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("rd"))
    if freq == "M":
        keep = F.col("rd") == F.last_day("rd")
    elif freq == "Q":
        keep = (F.col("rd") == F.last_day("rd")) & (F.month("rd") % 3 == 0)
    else:
        names = ["MON", "TUE", "WED", "THU", "FRI"]
        keep = F.weekday("rd") == names.index(freq.split("-")[1])
    return days.filter(keep).select("rd")


def latest_completed_session(cal: DataFrame, as_of: Column) -> DataFrame:
    return cal.filter(F.col("d") <= as_of).agg(F.max("d").alias("session"))


def holding_periods(rds: DataFrame) -> DataFrame:
    """(rd, rd_next) for consecutive rebalance dates; one small row per date."""
    from pyspark.sql import Window

    w = Window.partitionBy(F.lit(1)).orderBy("rd")
    return rds.select("rd", F.lead("rd").over(w).alias("rd_next"))
