"""Labels around episode anchors, forward returns, purged time splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.functions.rolling import series
from panelspark.sources.files import materialize

# Fixed values: (months before, months after, upper end included) around the surge start.
WINDOWS = {"pre_surge": (-6, 3, True), "pre_entry": (-6, -1, False), "continuation": (0, 3, True)}


def label_by_window(panel: DataFrame, episodes: DataFrame, name: str, lo: int, hi: int, include_hi: bool = True, anchor: str = "surge_start_date") -> DataFrame:
    """1 where rd falls into [anchor + lo, anchor + hi] of any episode of the asset, else 0.

    Windows are exploded to the months they touch, so the range join becomes an equi join on (asset, month).
    """
    a = F.col(anchor)
    ep = episodes.filter(a.isNotNull()).select("asset", F.add_months(a, lo).alias("_lo"), F.add_months(a, hi).alias("_hi"))
    ep = ep.withColumn("_m", F.explode(F.sequence(F.trunc("_lo", "MM"), F.trunc("_hi", "MM"), F.expr("interval 1 month"))))
    upper = F.col("rd") <= F.col("_hi") if include_hi else F.col("rd") < F.col("_hi")
    hits = panel.select("asset", "rd", F.trunc("rd", "MM").alias("_m")).join(ep, ["asset", "_m"]).filter((F.col("rd") >= F.col("_lo")) & upper)
    hits = hits.select("asset", "rd").distinct().withColumn(name, F.lit(1))
    return panel.join(hits, ["asset", "rd"], "left").withColumn(name, F.coalesce(name, F.lit(0)))


def label_windows(panel: DataFrame, episodes: DataFrame) -> DataFrame:
    episodes = materialize(episodes, "episodes")
    for name, (lo, hi, inc) in WINDOWS.items():
        panel = label_by_window(panel, episodes, f"is_{name}", lo, hi, inc)
    return panel


def forward_returns(prices: DataFrame, h: int = 3) -> DataFrame:
    """Return over the next h months and the lowest return on the way; NULL without a full horizon."""
    w = series("asset", order="rd")
    f = w.rowsBetween(1, h)
    df = prices.withColumns({"_e": F.lead("close", h).over(w), "_m": F.min("close").over(f)})
    ok = (F.col("close") > 0) & F.col("_e").isNotNull()
    return df.withColumns({"forward_return": F.when(ok, F.col("_e") / F.col("close") - 1), "forward_min_return": F.when(ok, F.col("_m") / F.col("close") - 1)}).drop("_e", "_m")


def label_risk(df: DataFrame, threshold: float = -0.20) -> DataFrame:
    col = "forward_min_return" if "forward_min_return" in df.columns else "forward_return" if "forward_return" in df.columns else None
    hit: Column = F.coalesce((F.col(col) <= threshold).cast("int"), F.lit(0)) if col else F.lit(0)
    return df.withColumn("is_risk", hit)


def fold_dates(dates: DataFrame, n_folds: int = 5, embargo: int = 0) -> DataFrame:
    """(fold, role, rd): expanding train blocks before equal test blocks, `embargo` dates dropped before each test.

    Works on the distinct dates only, a table bounded by the calendar.
    """
    d = dates.select("rd").distinct()
    one = Window.partitionBy(F.lit(1))
    pos = d.withColumns({"_p": F.row_number().over(one.orderBy("rd")) - 1, "_n": F.count(F.lit(1)).over(one)})
    pos = pos.withColumn("_size", F.floor(F.col("_n") / (n_folds + 1)))
    pos = pos.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    start = (F.col("fold") + 1) * F.col("_size")
    role = F.when(F.col("_p") < start - embargo, "train").when((F.col("_p") >= start) & (F.col("_p") < start + F.col("_size")), "test")
    return pos.withColumn("role", role).filter(F.col("role").isNotNull()).select("fold", "role", "rd")


def sized_folds(panel: DataFrame, folds: DataFrame, min_train: int = 100, min_test: int = 10) -> DataFrame:
    """All folds as (fold, role, rd, n_train, n_test, usable); usable folds have more rows than the minimum in both roles."""
    per_day = panel.groupBy("rd").agg(F.count(F.lit(1)).alias("n"))
    sizes = folds.join(per_day, "rd").groupBy("fold").agg(
        F.sum(F.when(F.col("role") == "train", F.col("n")).otherwise(0)).alias("n_train"), F.sum(F.when(F.col("role") == "test", F.col("n")).otherwise(0)).alias("n_test"))
    return folds.join(sizes, "fold").withColumn("usable", (F.col("n_train") > min_train) & (F.col("n_test") > min_test))


def walk_forward_splits(panel: DataFrame, n_folds: int = 5) -> DataFrame:
    return sized_folds(panel, fold_dates(panel, n_folds))


def purged_splits(panel: DataFrame, n_folds: int = 5, embargo: int = 9) -> DataFrame:
    return sized_folds(panel, fold_dates(panel, n_folds, embargo))


def label_balance(df: DataFrame, labels: list[str]) -> DataFrame:
    one = df.agg(*[F.struct(F.count_if(F.col(c) == 1).alias("positives"), F.count_if(F.col(c) == 0).alias("negatives"), F.avg(F.col(c).cast("double")).alias("prevalence")).alias(c) for c in labels])
    rows = F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"{c}.positives"), F.col(f"{c}.negatives"), F.col(f"{c}.prevalence")) for c in labels])
    return one.select(F.explode(rows).alias("x")).select("x.*")
