"""Vendor tables to canonical columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.functions.scalars import parse_number
from panelspark.sources.files import materialize, spread

# Investor classes of the market flow table, in output order.
INVESTOR_CLASSES = ["foreign", "inst", "individual", "pension", "inv_trust", "private_equity", "bank", "insurance", "etc"]


ROWS_PER_TASK = 1_000_000  # rows of all sources that one task puts together by key


def normalize_columns(df: DataFrame, rename: dict[str, str], numeric: list[str], dates: list[str], keep: list[str]) -> DataFrame:
    """Rename, coerce comma numbers and slashed or compact dates, upper-case the market, keep the listed columns."""
    out = df.withColumnsRenamed(rename)
    exprs = {c: parse_number(F.col(c)) for c in numeric if c in out.columns}
    for c in dates:
        if c in out.columns:
            exprs[c] = F.try_to_date(F.regexp_replace(F.col(c), "[/.-]", ""), "yyyyMMdd")
    if "market" in out.columns:
        exprs["market"] = F.upper("market")
    return out.withColumns(exprs).select(*[c for c in keep if c in out.columns])


def pivot_investor_classes(df: DataFrame) -> DataFrame:
    """Long (d, market, investor, net) to one row with nine class columns; an absent class is 0."""
    wide = df.groupBy("d", "market").agg(
        *[F.coalesce(F.sum(F.when(F.col("investor") == c, F.col("net"))), F.lit(0.0)).alias(f"{c}_net") for c in INVESTOR_CLASSES]
    )
    return wide


def null_if_zero(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit(0)) for c in cols})


def derive_traded_value(bars: DataFrame) -> DataFrame:
    own = F.col("value") if "value" in bars.columns else F.lit(None).cast("double")
    return bars.withColumn("value", F.coalesce(own, F.col("close") * F.col("volume")))


def first_available_source(sources: list[tuple[str, DataFrame]], keys: list[str]) -> DataFrame:
    """Per key, the row of the first source that has one; `source_identity` names it.

    The rows are written once and dealt out by key in parts of about a million, so the memory of a task does not follow the input.
    min_by keeps one row a key, so a key shared by many rows holds no more memory than another.
    """
    tagged = [df.withColumn("_p", F.lit(i)).withColumn("source_identity", F.lit(n)) for i, (n, df) in enumerate(sources)]
    allrows = materialize(reduce(lambda a, b: a.unionByName(b), tagged), "sources")
    rest = [c for c in allrows.columns if c not in keys and c != "_p"]
    best = spread(allrows, ROWS_PER_TASK, keys).groupBy(*keys).agg(F.min_by(F.struct(*rest), "_p").alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def net_value_from_qty(flow: DataFrame) -> DataFrame:
    """Net quantity times close; individuals take the other side."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    f, i = z("foreign_net_qty") * z("close"), z("inst_net_qty") * z("close")
    return flow.withColumns({"foreign_net_value": f, "inst_net_value": i, "individual_net_value": -(f + i)})


def series_to_daily_wide(series_long: DataFrame, names: list[str]) -> DataFrame:
    """Pivot named series, reindex to every calendar day and forward-fill."""
    from panelspark.operators.asof import ffill_daily

    wide = series_long.groupBy(F.col("obs_date").alias("d")).agg(
        *[F.max(F.when(F.col("series") == n, F.col("value"))).alias(n) for n in names]
    )
    return ffill_daily(wide, names)


def union_events(frames: dict[str, DataFrame]) -> DataFrame:
    """Stack event tables with different columns under their category."""
    tagged = [df.withColumn("event_category", F.lit(c)) for c, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def map_corp_to_asset(panel: DataFrame, corp_map: DataFrame) -> DataFrame:
    return panel.join(corp_map.select("corp_code", "asset"), "corp_code", "left")


def corp_coverage(mapped: DataFrame) -> DataFrame:
    """How many rows and issuers of a mapped panel found an asset."""
    issuers = mapped.groupBy("corp_code").agg(F.count(F.lit(1)).alias("n"), F.count("asset").alias("m"))
    return issuers.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("m"), F.lit(0)).alias("n_mapped"), F.count(F.lit(1)).alias("n_issuers"), F.count_if(F.col("m") > 0).alias("n_issuers_mapped"))


def enrich_name(df: DataFrame, corp_map: DataFrame) -> DataFrame:
    names = corp_map.select("asset", F.col("name").alias("_n"))
    base = df.drop("name")
    return base.join(names, "asset", "left").withColumn("name", F.coalesce("_n", F.lit(""))).drop("_n")


def keep_last(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the last by a total order; max_by aggregates map-side."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def append_dedup(existing: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Add the rows whose key is not there yet, keeping the last new row per key."""
    fresh = keep_last(new.join(existing.select(*key).distinct(), key, "left_anti"), key, order)
    return existing.unionByName(fresh.select(*existing.columns))


def frame_digest(df: DataFrame, key: str, day: str, value: str, scale: int = 1_000_000) -> DataFrame:
    """Content hash of each (day, value) series, independent of row order; one short series per key."""
    item = F.struct(F.col(day).alias("d"), F.round(F.col(value) * scale).cast("bigint").alias("v"))
    text = F.array_join(
        F.transform(F.array_sort(F.collect_list(item)), lambda x: F.concat(x["d"].cast("string"), F.lit("="), x["v"].cast("string"))), ","
    )
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sha2(text, 256).alias("digest"))


# Standard accounts with their account ids and, as fallback, account names, in order of preference.
KEY_ACCOUNTS = {
    "revenue": (["ifrs-full_Revenue", "ifrs_Revenue", "revenue"], ["매출액", "매출", "수익(매출액)", "영업수익"]),
    "operating_income": (
        ["dart_OperatingIncomeLoss", "ifrs-full_OperatingIncomeLoss", "ifrs-full_ProfitLossFromOperatingActivities"],
        ["영업이익", "영업이익(손실)"],
    ),
    "net_income": (
        ["ifrs-full_ProfitLoss", "dart_ProfitLossOfTheCurrentTerm", "ifrs-full_ProfitLossAttributableToOwnersOfParent"],
        ["당기순이익", "당기순이익(손실)", "지배기업 소유주지분 순이익"],
    ),
    "total_assets": (["ifrs-full_Assets"], ["자산총계", "자산총계(자산총계)"]),
    "total_equity": (
        ["ifrs-full_Equity", "ifrs-full_EquityAttributableToOwnersOfParent"],
        ["자본총계", "지배기업 소유주지분", "자본총계(자본총계)"],
    ),
    "total_liabilities": (["ifrs-full_Liabilities"], ["부채총계"]),
    "operating_cash_flow": (
        ["ifrs-full_CashFlowsFromUsedInOperatingActivities", "ifrs_CashFlowsFromUsedInOperatingActivities"],
        ["영업활동현금흐름", "영업활동으로 인한 현금흐름"],
    ),
}


def extract_accounts(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Statement lines (keys, line_no, account_id, account_nm, amount) -> one row with seven accounts.

    First non-null amount by account id in preference order, then by substring of the account name.
    All candidates are evaluated in one pass with a map-side combined min_by.
    """
    aggs = []
    for std, (ids, names) in KEY_ACCOUNTS.items():
        prio = F.lit(None).cast("int")
        for i, n in reversed(list(enumerate(names))):
            prio = F.when(F.contains(F.col("account_nm"), F.lit(n)), len(ids) + i).otherwise(prio)
        for i, a in reversed(list(enumerate(ids))):
            prio = F.when(F.col("account_id") == a, i).otherwise(prio)
        order = F.when(prio.isNotNull() & F.col("amount").isNotNull(), F.struct(prio, F.col("line_no")))
        aggs.append(F.min_by("amount", order).alias(std))
    return lines.groupBy(*keys).agg(*aggs)


def quarterly_panel(lines: DataFrame) -> DataFrame:
    """One row per (corp_code, year, reprt_code): accounts, first receipt date and the period end of the report."""
    keys = ["corp_code", "year", "reprt_code"]
    acc = extract_accounts(lines, keys)
    rcept = lines.filter(F.col("rcept_dt").isNotNull()).groupBy(*keys).agg(F.min_by("rcept_dt", "line_no").alias("rcept_dt"))
    # Report code to last month of its period.
    month = F.create_map(*[F.lit(x) for kv in {"11013": 3, "11012": 6, "11014": 9, "11011": 12}.items() for x in kv])
    return acc.join(rcept, keys, "left").withColumn(
        "period_end", F.last_day(F.make_date("year", month[F.col("reprt_code")], F.lit(1)))
    )
