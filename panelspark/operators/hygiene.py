"""Row hygiene, point-in-time visibility and fail-closed guards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from panelspark.functions.rolling import running, series
from panelspark.functions.scalars import finite
from panelspark.operators.asof import asof


def hard_sanitize(df: DataFrame, cols: list[str], fill: float = 0.0) -> DataFrame:
    return df.withColumns({c: F.coalesce(finite(F.col(c).cast("double")), F.lit(fill)) for c in cols})


def pit_visible(df: DataFrame, known: str, as_of: str) -> DataFrame:
    """Rows whose knowledge date is set and not after the as-of date."""
    return df.filter(F.col(known).isNotNull() & (F.col(known) <= F.col(as_of)))


def in_lookback_months(event_date: Column, as_of: Column, months: int) -> Column:
    """Half-open (as_of - months, as_of]."""
    return (event_date > F.add_months(as_of, -months)) & (event_date <= as_of)


def in_lookback_days(event_date: Column, as_of: Column, days: int) -> Column:
    """Closed [as_of - days, as_of]."""
    return event_date.between(F.date_sub(as_of, days), as_of)


def window_counts(events: DataFrame, keys: DataFrame, date: str, windows: dict[str, Column | None]) -> DataFrame:
    """(asset, rd, one count per window) for every key: events after the window's last day before it, up to rd; None counts from the start.

    Events are summed per day and looked up as running totals, so no key is paired with its events.
    """
    daily = events.filter(F.col(date).isNotNull()).groupBy("asset", F.col(date).alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    totals = daily.withColumn("_n", F.sum("_n").over(running(series("asset", order="_d"))))
    ends = [("_end", F.col("rd"))] + [(n, before) for n, before in windows.items() if before is not None]
    targets = keys.select("asset", "rd", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), t.alias("t")) for n, t in ends])).alias("_e"))
    got = asof(targets.select("asset", "rd", F.col("_e.n").alias("_w"), F.col("_e.t").alias("_t0")), totals, ["asset"], "_t0", "_d", ["_n"])
    at = lambda n: F.coalesce(F.max(F.when(F.col("_w") == n, F.col("_n"))), F.lit(0))
    return got.groupBy("asset", "rd").agg(*[(at("_end") - at(n) if b is not None else at("_end")).alias(n) for n, b in windows.items()])


def numeric_columns(df: DataFrame, exclude: set[str]) -> list[str]:
    ok = (T.NumericType, T.BooleanType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, ok) and f.name not in exclude]


def null_rates(df: DataFrame, cols: list[str], keys: list[str] | None = None) -> DataFrame:
    """(feature, null_rate): one pass over the data, then one short unpivot."""
    one = df.groupBy(*(keys or [])).agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    return one.unpivot(keys or [], cols, "feature", "null_rate")


def select_feature_columns(df: DataFrame, exclude: set[str], max_null_rate: float = 0.5) -> DataFrame:
    """(feature, null_rate, selected) for the numeric and boolean columns outside the exclusion set."""
    rates = null_rates(df, numeric_columns(df, exclude))
    return rates.withColumn("selected", F.col("null_rate") <= max_null_rate)


def coverage_report(df: DataFrame, cols: list[str]) -> DataFrame:
    return null_rates(df, cols).select("feature", (1 - F.col("null_rate")).alias("coverage"))


def labelled_only(df: DataFrame, label: str = "label") -> DataFrame:
    return df.filter(F.col(label).isin(0, 1))


def align_features(df: DataFrame, features: list[str], keep: list[str]) -> tuple[DataFrame, list[str]]:
    """Project to the training features in order; absent columns and NULLs are 0. Returns the missing names too."""
    missing = [c for c in features if c not in df.columns]
    cols = [F.lit(0.0).alias(c) if c in missing else F.coalesce(finite(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in features]
    return df.select(*keep, *cols), missing


def incomplete_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows in which a required value is NULL, NaN or infinite."""
    bad = reduce(lambda a, b: a | b, [finite(F.col(c).cast("double")).isNull() for c in cols])
    return df.filter(bad)


def assert_complete(df: DataFrame, cols: list[str]) -> DataFrame:
    """Fail closed: the returned frame raises at run time on the first incomplete row."""
    boolean = [f.name for f in df.schema.fields if f.name in cols and isinstance(f.dataType, T.BooleanType)]
    if boolean:
        raise ValueError(f"boolean where a number is required: {boolean}")
    checked = {}
    for c in cols:
        v = finite(F.col(c).cast("double"))
        checked[c] = F.when(v.isNull(), F.raise_error(F.lit(f"incomplete value in {c}")).cast("double")).otherwise(v)
    return df.withColumns(checked)


def strict_violations(df: DataFrame, key: str, day: str = "d", price: str = "close") -> DataFrame:
    """(key, code, n): bad dates, missing or non-positive prices, duplicate dates; empty means clean."""
    p = finite(F.col(price))
    per_day = df.groupBy(key, day).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(p.isNull()).alias("missing_close"),
        F.count_if(p <= 0).alias("non_positive_close"),
    )
    codes = ["bad_date", "missing_close", "non_positive_close", "duplicate_date"]
    sums = per_day.groupBy(key).agg(
        F.sum(F.when(F.col(day).isNull(), F.col("n")).otherwise(0)).alias("bad_date"),
        F.sum("missing_close").alias("missing_close"),
        F.sum("non_positive_close").alias("non_positive_close"),
        F.count_if(F.col(day).isNotNull() & (F.col("n") > 1)).alias("duplicate_date"),
    )
    return sums.unpivot([key], codes, "code", "n").filter(F.col("n") > 0)


def registry_gaps(panel: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """Registry members that are missing from the panel or appear more than once: (key, n)."""
    counts = panel.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return registry.select(key).join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n")).filter(F.col("n") != 1)
