"""Panel tables derived from the star-schema Parquet tables of one folder.

Raw facts are aggregated once to (asset, day) with map-side partial aggregation,
so everything downstream sees at most one row per asset and day. Money sums use
integer cents and are therefore independent of the order of the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelspark.functions.rolling import running, series
from panelspark.functions.scalars import padded
from panelspark.operators.asof import asof
from panelspark.sources.files import input_state, landed

# Event categories in catalog order.
EVENT_CATEGORIES = [
    "treasury_buyback", "capital_increase", "bonus_issue", "treasury_sell", "convertible_bond",
    "warrant_bond", "insider_holdings", "major_holders", "merger", "spinoff", "capital_reduction",
]

# Raw macro series names, three per order priority (order status F, O, P), with their scale.
MACRO_SERIES = [
    ("bok_base_rate", 100000.0), ("ktb_3y_yield", 100000.0), ("ktb_10y_yield", 80000.0),
    ("usd_krw", 200.0), ("kr_pmi", 5000.0), ("consumer_sentiment", 2500.0),
    ("business_sentiment", 3000.0), ("kr_industrial_prod", 2500.0), ("kr_export_yoy", 20000.0),
    ("us_10y", 60000.0), ("us_2y", 70000.0), ("vix", 12000.0),
    ("dxy", 2500.0), ("wti_close", 3500.0), ("cpi_yoy", 90000.0),
]

# Report codes by fiscal quarter (Q1, half year, Q3, annual).
REPORT_CODES = ["11013", "11012", "11014", "11011"]

# Investor classes a line number stands for.
INVESTORS = ["individual", "foreign", "inst", "pension", "inv_trust", "private_equity", "bank"]


def asset_id(key: Column) -> Column:
    return padded(key, 6)


def exchange_of(key: Column) -> Column:
    return F.when(key % 2 == 0, "KOSPI").otherwise("KOSDAQ")


# Prices are whole ticks (hundredths), so sums over any window are exact whatever the row order.
_VWAP = "cast((2 * pv + 100 * qty) div (200 * qty) as double)"


def _cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


class Star:
    """Accessors; each call returns a plan. Line items are read once for each state of the input: the (supplier, day)
    table lands in the shared folder and every accessor of bars, calendars, keys and flows reads that; so do keys and month closes, which most queries read several times."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def landed(self, name: str, tables: list[str], build: Callable[[], DataFrame]) -> DataFrame:
        """build() written once for each state of the tables it reads."""
        state = input_state(self.spark, *[f"{self.path}/{t}.parquet" for t in tables])
        return self.spark.read.parquet(landed(self.spark, name, state, lambda folder: build().write.parquet(folder)))

    def _daily(self) -> DataFrame:
        return self.landed("daily", ["lineitem", "part"], self._line_items_by_day)

    def _line_items_by_day(self) -> DataFrame:
        li = self.table("lineitem").select(
            "l_partkey", "l_suppkey", "l_returnflag",
            F.to_date("l_shipdate").alias("d"), _cents("l_extendedprice").alias("amt"),
            F.when(F.col("l_linestatus") == "O", 1).when(F.col("l_linestatus") == "F", -1).alias("sgn"),
            (100 - _cents("l_discount")).alias("keep"),
            _cents("l_tax").alias("tax"),
            F.col("l_quantity").cast("bigint").alias("qty"),
        )
        part = self.table("part").select("p_partkey", _cents("p_retailprice").alias("rp"))
        px = li.join(part, li.l_partkey == part.p_partkey).withColumn("px4", F.col("rp") * F.col("keep"))
        signed = lambda flag, c: F.sum(F.when(F.col("l_returnflag") == flag, F.col("sgn") * F.col(c)).otherwise(0))
        return px.groupBy("l_suppkey", "d").agg(
            F.sum(F.col("px4") * F.col("qty")).alias("pv"),
            F.sum("qty").alias("qty"),
            F.max(F.col("px4") * (200 + F.col("tax"))).alias("hi"),
            F.min(F.col("px4") * (200 - F.col("tax"))).alias("lo"),
            F.count("sgn").alias("n_flow"), signed("A", "amt").alias("f"), signed("R", "amt").alias("i"), signed("A", "qty").alias("fq"), F.sum(F.col("sgn") * F.col("qty") * F.col("sgn")).alias("q"),
        )

    def bars(self) -> DataFrame:
        """(asset, d, high, low, close, volume, value): one bar per supplier and ship date."""
        return self._daily().select(
            asset_id(F.col("l_suppkey")).alias("asset"), "d",
            F.expr("cast((hi + 19999) div 20000 as double)").alias("high"),
            F.expr("cast(lo div 20000 as double)").alias("low"),
            F.expr(_VWAP).alias("close"),
            F.col("qty").cast("double").alias("volume"),
            F.expr("cast(pv div 100 as double)").alias("value"),
        )

    def index_bars(self) -> DataFrame:
        """(index_id, d, close, volume): traded-value weighted price of the whole market and of each exchange."""
        return (
            self._daily()
            .withColumn("index_id", F.explode(F.array(F.lit("ALL"), exchange_of(F.col("l_suppkey")))))
            .groupBy("index_id", "d")
            .agg(F.sum("pv").alias("pv"), F.sum("qty").alias("qty"))
            .select(
                "index_id", "d",
                F.expr(_VWAP).alias("close"),
                F.col("qty").cast("double").alias("volume"),
            )
        )

    def market(self) -> DataFrame:
        return self.index_bars().filter(F.col("index_id") == "ALL").drop("index_id")

    def sector_bars(self) -> DataFrame:
        """(sector, d, close): traded-value weighted price of each sector."""
        daily = self._daily().withColumn("asset", asset_id(F.col("l_suppkey")))
        return (
            daily.join(self.assets().select("asset", "sector"), "asset").groupBy("sector", "d")
            .agg(F.sum("pv").alias("pv"), F.sum("qty").alias("qty")).select("sector", "d", F.expr(_VWAP).alias("close"))
        )

    def assets(self) -> DataFrame:
        k = F.col("s_suppkey")
        name = F.concat(
            "s_name", F.when(k % 23 == 3, " SPAC").when(k % 29 == 4, " REIT").otherwise("")
        )
        return self.table("supplier").select(
            asset_id(k).alias("asset"), name.alias("name"), exchange_of(k).alias("exchange"),
            F.concat(F.lit("S"), (F.col("s_nationkey") % 5).cast("string")).alias("sector"),
            (k % 5 == 0).alias("group_flag"),
            F.col("s_nationkey").alias("industry"),
            ((F.col("s_nationkey") + 1) * F.lit(2500000).cast("bigint")).alias("listed_shares"),
        )

    def calendar(self) -> DataFrame:
        """Trading days: every date on which anything traded."""
        return self._daily().select("d").distinct()

    def month_ends(self) -> DataFrame:
        """Last trading day of each month, as rd."""
        return (
            self._daily().groupBy(F.trunc("d", "MM").alias("m")).agg(F.max("d").alias("rd"))
        )

    def keys(self) -> DataFrame:
        """(asset, rd): month ends between an asset's first and last bar (the last month included)."""
        return self.landed("keys", ["lineitem", "part"], self._month_ends_of_assets)

    def _month_ends_of_assets(self) -> DataFrame:
        span = self._daily().groupBy("l_suppkey").agg(F.min("d").alias("a"), F.max("d").alias("b"))
        months = span.select(
            asset_id(F.col("l_suppkey")).alias("asset"),
            F.explode(F.sequence(F.trunc("a", "MM"), F.trunc("b", "MM"), F.expr("interval 1 month"))).alias("m"),
        )
        return months.join(self.month_ends(), "m").select("asset", "rd")

    def month_closes(self) -> DataFrame:
        """(asset, rd, close): close as of each month end."""
        return self.landed("month-closes", ["lineitem", "part"], lambda: asof(self.keys(), self.bars(), ["asset"], "rd", "d", ["close"]))

    def mcap(self) -> DataFrame:
        """(asset, snapshot_date, market, market_cap, listed_shares): one membership snapshot per month end."""
        return (
            self.month_closes().join(self.assets(), "asset")
            .select(
                "asset", F.col("rd").alias("snapshot_date"), F.col("exchange").alias("market"),
                (F.col("close") * F.col("listed_shares")).alias("market_cap"), "listed_shares",
            )
        )

    def listed(self) -> DataFrame:
        """Month-end snapshots of the assets that traded on at least six days of the month."""
        active = self._daily().groupBy("l_suppkey", F.trunc("d", "MM").alias("m")).agg(F.count(F.lit(1)).alias("n"))
        active = active.filter(F.col("n") >= 6).select(asset_id(F.col("l_suppkey")).alias("asset"), "m")
        return self.mcap().withColumn("m", F.trunc("snapshot_date", "MM")).join(active, ["asset", "m"], "left_semi").drop("m")

    def presence(self) -> DataFrame:
        """(asset, snapshot_date, market): parts shipped in a month, a sparse membership history."""
        return (
            self.table("lineitem")
            .select(
                asset_id(F.col("l_partkey")).alias("asset"),
                F.last_day(F.to_date("l_shipdate")).alias("snapshot_date"),
                exchange_of(F.col("l_partkey")).alias("market"),
            )
            .distinct()
        )

    def flow(self) -> DataFrame:
        """(asset, d, foreign_net, inst_net, individual_net, holding_pct)."""
        day = self._daily().filter("n_flow > 0")
        w = running(series("l_suppkey"))
        return day.select(
            asset_id(F.col("l_suppkey")).alias("asset"), "d",
            F.col("f").cast("double").alias("foreign_net"), F.col("i").cast("double").alias("inst_net"),
            (-(F.col("f") + F.col("i"))).cast("double").alias("individual_net"),
            (F.lit(50.0) + F.lit(50.0) * F.sum("fq").over(w) / F.sum("q").over(w)).alias("holding_pct"),
        )

    def investor_flow(self) -> DataFrame:
        """(market, d, investor, net): long market-level flow by investor class."""
        li = self.table("lineitem")
        return (
            li.select(
                exchange_of(F.col("l_suppkey")).alias("market"), F.to_date("l_shipdate").alias("d"),
                F.element_at(F.array(*[F.lit(x) for x in INVESTORS]), F.col("l_linenumber")).alias("investor"),
                (F.when(F.col("l_linestatus") == "O", 1).otherwise(-1) * _cents("l_extendedprice")).alias("c"),
            )
            .groupBy("market", "d", "investor").agg(F.sum("c").cast("double").alias("net"))
        )

    def _issuer(self) -> Column:
        """Orders belong to issuers: customer keys folded onto the listed suppliers."""
        last = self.table("supplier").agg(F.max("s_suppkey").alias("k")).scalar()
        return asset_id(F.col("o_custkey") % (last + 1))

    def fundamentals(self, amended: bool = False) -> DataFrame:
        """Quarterly filings (asset, year, reprt_code, period_end, rcept_dt, accounts); flows are year to date.

        With `amended`, a third of them are filed once more, up to 17 months later, without the orders still pending.
        """
        o = self.table("orders").select(
            self._issuer().alias("asset"), F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("qtr"),
            "o_orderstatus", _cents("o_totalprice").alias("c"),
        )
        st = F.col("o_orderstatus")
        q = o.groupBy("asset", "year", "qtr").agg(
            F.sum("c").alias("rev"),
            F.sum(F.when(st == "F", -F.col("c")).otherwise(F.col("c"))).alias("op"),
            F.sum(F.when(st == "O", F.col("c")).when(st == "F", -F.col("c")).otherwise(0)).alias("ni"),
            F.sum(F.when(st == "F", F.col("c")).otherwise(0)).alias("li"), F.sum(F.when(st == "P", F.col("c")).otherwise(0)).alias("pend"),
        )
        ytd, life = running(series("asset", "year", order="qtr")), running(series("asset", order="pos"))
        total = lambda c, w: F.sum(c).over(w)
        pos, n, v = F.col("year") * 4 + F.col("qtr"), F.col("asset").cast("int"), F.col("version")
        versions = F.sequence(F.lit(0), F.when((n + F.col("pos")) % 3 == 0, 1).otherwise(0) if amended else F.lit(0))
        q = q.withColumn("pos", pos).select(
            "asset", "year", "qtr", "pos", F.last_day(F.make_date("year", F.col("qtr") * 3, F.lit(1))).alias("period_end"),
            total("rev", ytd).alias("rev"), total("op", ytd).alias("op"), total("ni", ytd).alias("ni"), total("pend", ytd).alias("pend"),
            total("rev", life).alias("assets"), total("li", life).alias("li"), total("pend", life).alias("pending"),
        ).withColumn("version", F.explode(versions))
        money = lambda c: (c / F.lit(100.0))
        return q.select(
            "asset", "year", F.element_at(F.array(*[F.lit(x) for x in REPORT_CODES]), F.col("qtr")).alias("reprt_code"), "period_end",
            F.date_add("period_end", (F.lit(45) + n % 30 + v * (20 + n % 10 * 50)).cast("int")).alias("rcept_dt"),
            money(F.col("rev") - v * F.col("pend")).alias("revenue"), money(F.col("op") - v * F.col("pend")).alias("operating_income"), money(F.col("ni")).alias("net_income"),
            money(F.col("assets") - v * F.col("pending")).alias("total_assets"), money(F.col("assets") - F.col("li") - v * F.col("pending")).alias("total_equity"),
            money(F.col("li")).alias("total_liabilities"),
        )

    def disclosures(self) -> DataFrame:
        """Heterogeneous disclosure events with per-category fields (NULL where a field does not apply)."""
        o = self.table("orders")
        cat = F.element_at(F.array(*[F.lit(c) for c in EVENT_CATEGORIES]), (F.col("o_orderkey") % 11 + 1).cast("int"))
        only = lambda cats, v: F.when(F.col("event_category").isin(*cats), v)
        amt, qty = F.col("cents") * 100, F.lit(100000).cast("bigint")
        base = o.select(
            self._issuer().alias("asset"), F.to_date("o_orderdate").alias("rcept_dt"),
            F.concat(F.date_format("o_orderdate", "yyyyMMdd"), padded(F.col("o_orderkey"), 6)).alias("rcept_no"),
            cat.alias("event_category"), _cents("o_totalprice").alias("cents"), "o_orderpriority", "o_orderstatus", "o_custkey",
        )
        st = F.col("o_orderstatus")
        return base.select(
            "asset", "rcept_no", "rcept_dt", "event_category",
            only(["treasury_buyback"], amt).alias("aqpln_prc_ostk"),
            only(["treasury_sell"], amt).alias("dppln_prc_ostk"),
            only(["convertible_bond", "warrant_bond"], amt * 10).alias("bd_fta"),
            only(["capital_increase"], qty).alias("nstk_ostk_qy"),
            only(["capital_increase"], (F.col("cents").cast("decimal(12,0)") * F.lit(0.01).cast("decimal(3,2)"))).alias("bdis_pric"),
            only(["capital_increase"], F.when(F.col("o_orderpriority") == "1-URGENT", "제3자배정증자").otherwise("주주배정증자")).alias("ic_mthn"),
            only(["spinoff"], F.when(st == "F", "물적분할").otherwise("인적분할")).alias("div_mth"),
            only(["insider_holdings"], F.col("o_custkey")).alias("bsis_stkqy"),
            only(["insider_holdings"], F.col("o_custkey") + F.when(st == "O", 5000).when(st == "F", -5000).otherwise(0)).alias("aft_stkqy"),
            only(["insider_holdings"], (F.col("cents").cast("decimal(12,0)") * F.lit(0.1).cast("decimal(2,1)"))).alias("trade_uv"),
            only(["major_holders"], (F.col("o_custkey") % 201 - 100).cast("decimal(6,0)") * F.lit(0.01).cast("decimal(3,2)")).alias("stkrt_irds"),
        )

    def macro(self) -> DataFrame:
        """(series, obs_date, value): one series per (order priority, order status), daily mean order value."""
        p = F.substring("o_orderpriority", 1, 1).cast("int")
        s = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
        names = F.array(*[F.struct(F.lit(n).alias("series"), F.lit(x).alias("scale")) for n, x in MACRO_SERIES])
        return (
            self.table("orders")
            .select(((p - 1) * 3 + s + 1).alias("k"), F.to_date("o_orderdate").alias("obs_date"), _cents("o_totalprice").alias("c"))
            .groupBy("k", "obs_date").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n"))
            .withColumn("m", F.element_at(names, F.col("k")))
            .select("m.series", "obs_date", (F.col("c").cast("double") / (F.col("n") * 100).cast("double") / F.col("m.scale")).alias("value"))
        )

    def themes(self) -> DataFrame:
        """(theme, asset): many-to-many membership."""
        k = F.col("s_suppkey")
        tag = lambda p, m: F.concat(F.lit(p), (k % m).cast("string"))
        return self.table("supplier").select(
            F.explode(F.array(tag("A", 6), tag("B", 10), tag("C", 4))).alias("theme"), asset_id(k).alias("asset")
        )

    def ticks(self) -> DataFrame:
        """(asset, ts, price, event_type, event_id) from the event stream table."""
        last = self.table("supplier").agg(F.max("s_suppkey").alias("k")).scalar()
        return self.table("events").select(
            asset_id(F.col("user_id") % (last + 1)).alias("asset"), "ts", F.col("value").alias("price"), "event_type", "event_id"
        )
