"""Sources, sinks and normalisation."""

from pyspark.sql import functions as F

from panelspark.catalog.oracle import C
from panelspark.functions.scalars import padded
from panelspark.catalog.registry import query
from panelspark.functions import scalars as X
from panelspark.sources import calendars as K, files, normalize as N
from panelspark.sources.star import MACRO_SERIES


@query("read_dated_snapshots", "asset snapshot_date:d market", "presence", "SELECT * FROM presence")
def _(s):
    path = files.scratch(s.spark, "snapshots")
    files.write_dated_snapshots(s.presence(), path)
    return files.read_dated_snapshots(s.spark, path, ["asset", "market"])


@query("panel_round_trip", "asset rebalance_date:d close:6", "mclose", "SELECT asset, rd AS rebalance_date, close FROM mclose")
def _(s):
    path = files.scratch(s.spark, "panel")
    files.write_panel(s.month_closes().withColumnRenamed("rd", "rebalance_date"), path)
    return files.read_panel(s.spark, path)


@query("picks_csv_round_trip", "rebalance_date:d ticker rank_in_month:i score:6", "mclose",
       "SELECT * FROM (SELECT rd AS rebalance_date, asset AS ticker, round(close, 4) AS score, row_number() OVER (PARTITION BY rd ORDER BY close DESC, asset) AS rank_in_month FROM mclose) WHERE rank_in_month <= 10")
def _(s):
    from panelspark.operators.xsection import rank_in_date

    path = files.scratch(s.spark, "picks")
    top = rank_in_date(s.month_closes(), "close", 10, out="rank_in_month").select(
        F.col("rd").alias("rebalance_date"), F.col("asset").alias("ticker"), F.lit(None).cast("double").alias("market_cap"),
        F.round("close", 4).alias("score"), "rank_in_month",
    )
    files.write_portfolio_csv(top, path)
    return files.read_picks_csv(s.spark, path)


@query("report_json_round_trip", "exchange n_assets:i total_shares:i", "assets",
       "SELECT exchange, count(*) AS n_assets, sum(listed_shares) AS total_shares FROM assets GROUP BY 1")
def _(s):
    path = files.scratch(s.spark, "report")
    rep = s.assets().groupBy("exchange").agg(F.count(F.lit(1)).alias("n_assets"), F.sum("listed_shares").alias("total_shares"))
    files.write_report_json(rep.select("exchange", F.struct("n_assets", "total_shares").alias("metrics")), path)
    return s.spark.read.schema("exchange string, metrics struct<n_assets:bigint,total_shares:bigint>").json(path).select("exchange", "metrics.*")


@query("load_registry", "key asset", "themes", "SELECT theme AS key, asset FROM themes")
def _(s):
    path = files.scratch(s.spark, "registry")
    reg = s.themes().groupBy(F.col("theme").alias("key")).agg(F.array_sort(F.collect_list("asset")).alias("members"))
    reg.withColumn("name", F.col("key")).write.json(path)
    return files.load_registry(s.spark, path)


@query("read_corp_codes_xml", "corp_code corp_name asset modify_date:d", "assets",
       "SELECT lpad(asset, greatest(8, length(asset))::INT, '0') AS corp_code, name AS corp_name, asset, DATE '2001-01-31' AS modify_date FROM assets WHERE exchange = 'KOSPI'")
def _(s):
    path = files.scratch(s.spark, "corp")
    s.assets().select(
        padded(F.col("asset"), 8).alias("corp_code"), F.col("name").alias("corp_name"),
        F.when(F.col("exchange") == "KOSPI", F.col("asset")).otherwise("-").alias("stock_code"), F.lit("20010131").alias("modify_date"),
    ).write.format("xml").option("rowTag", "list").option("rootTag", "result").save(path)
    return files.read_corp_codes_xml(s.spark, path)


@query("normalize_columns", "asset d:d market close:2", "",
       "SELECT lpad(CAST(o_custkey AS VARCHAR), greatest(6, length(CAST(o_custkey AS VARCHAR)))::INT, '0') AS asset, CAST(o_orderdate AS DATE) AS d, upper(o_orderpriority) AS market, o_totalprice AS close FROM orders")
def _(s):
    vendor = s.table("orders").select(
        F.col("o_custkey").cast("string").alias("종목코드"), F.date_format("o_orderdate", "yyyy/MM/dd").alias("일자"),
        F.lower("o_orderpriority").alias("시장구분"), F.format_number("o_totalprice", 2).alias("종가"), F.lit("x").alias("비고"),
    )
    out = N.normalize_columns(vendor, {"종목코드": "asset", "일자": "d", "시장구분": "market", "종가": "close"}, ["close"], ["d"], ["asset", "d", "market", "close"])
    return out.withColumn("asset", X.normalize_asset(F.col("asset")))


@query("parse_number", "o_orderkey:i txt num:2", "", """
    SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN '-' WHEN 'F' THEN 'neg' ELSE 'pos' END AS txt,
           CASE o_orderstatus WHEN 'P' THEN NULL WHEN 'F' THEN -o_totalprice ELSE o_totalprice END AS num FROM orders""")
def _(s):
    st, body = F.col("o_orderstatus"), F.format_number("o_totalprice", 2)
    raw = F.when(st == "P", "-").when(st == "F", F.concat(F.lit(" -"), body, F.lit("%"))).otherwise(F.concat(F.lit("+"), body))
    return s.table("orders").select("o_orderkey", F.when(st == "P", "-").when(st == "F", "neg").otherwise("pos").alias("txt"), X.parse_number(raw).alias("num"))


_CLASSES = " ".join(f"{c}_net:2" for c in N.INVESTOR_CLASSES)


@query("pivot_investor_classes", f"market d:d {_CLASSES}", "invflow",
       "SELECT market, d, " + ", ".join(f"coalesce(sum(net) FILTER (investor = '{c}'), 0) AS {c}_net" for c in N.INVESTOR_CLASSES) + " FROM invflow GROUP BY 1, 2")
def _(s):
    return N.pivot_investor_classes(s.investor_flow())


@query("null_if_zero", "asset d:d net_foreign:2 net_inst:2", "flow",
       "SELECT asset, d, nullif(foreign_net, 0) AS net_foreign, nullif(inst_net, 0) AS net_inst FROM flow")
def _(s):
    return N.null_if_zero(s.flow(), ["foreign_net", "inst_net"]).withColumnsRenamed({"foreign_net": "net_foreign", "inst_net": "net_inst"})


@query("derive_traded_value", "asset d:d value:4", "bars", "SELECT asset, d, CASE WHEN volume > 25 THEN value ELSE close * volume END AS value FROM bars")
def _(s):
    return N.derive_traded_value(s.bars().withColumn("value", F.when(F.col("volume") > 25, F.col("value"))))


@query("first_available_source", "asset d:d net:2 source_identity", "", f"""
    SELECT lpad(CAST(l_suppkey AS VARCHAR), greatest(6, length(CAST(l_suppkey AS VARCHAR)))::INT, '0') AS asset, d, CASE WHEN o IS NOT NULL THEN o ELSE f END / 100.0 AS net,
           CASE WHEN o IS NOT NULL THEN 'open' ELSE 'filled' END AS source_identity
    FROM (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS d, CAST(sum({C.format(c='l_extendedprice')}) FILTER (l_linestatus = 'O') AS DOUBLE) AS o,
            CAST(sum({C.format(c='l_extendedprice')}) FILTER (l_linestatus = 'F') AS DOUBLE) AS f FROM lineitem GROUP BY 1, 2)
    WHERE o IS NOT NULL OR f IS NOT NULL""")
def _(s):
    def src(status):
        return (
            s.table("lineitem").filter(F.col("l_linestatus") == status)
            .groupBy(padded(F.col("l_suppkey"), 6).alias("asset"), F.to_date("l_shipdate").alias("d"))
            .agg((F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")) / F.lit(100.0)).alias("net"))
        )
    return N.first_available_source([("open", src("O")), ("filled", src("F"))], ["asset", "d"])


@query("net_value_from_qty", "asset d:d foreign_net_value:4 inst_net_value:4 individual_net_value:4", "bars flow", """
    SELECT asset, d, CASE WHEN foreign_net > 0 THEN volume ELSE -volume END * close AS foreign_net_value, 0.5 * volume * close AS inst_net_value,
           -(CASE WHEN foreign_net > 0 THEN volume ELSE -volume END * close + 0.5 * volume * close) AS individual_net_value FROM bars JOIN flow USING (asset, d)""")
def _(s):
    df = s.bars().join(s.flow(), ["asset", "d"]).withColumns({
        "foreign_net_qty": F.when(F.col("foreign_net") > 0, F.col("volume")).otherwise(-F.col("volume")), "inst_net_qty": 0.5 * F.col("volume"),
    })
    return N.net_value_from_qty(df)


@query("parse_period", "o_orderkey:i cycle period back obs:d", "", """
    SELECT o_orderkey, cycle, period, period AS back, CASE cycle WHEN 'A' THEN make_date(CAST(year(d) AS INT), 12, 31)
      WHEN 'Q' THEN last_day(make_date(CAST(year(d) AS INT), CAST(quarter(d) * 3 AS INT), 1)) WHEN 'M' THEN last_day(d) ELSE d END AS obs
    FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, ['A','Q','M','D'][o_orderkey % 4 + 1] AS cycle,
      CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y') || 'Q' || quarter(o_orderdate)
        WHEN 2 THEN strftime(o_orderdate, '%Y%m') ELSE strftime(o_orderdate, '%Y%m%d') END AS period FROM orders)""")
def _(s):
    cycle = F.element_at(F.array(*[F.lit(c) for c in "AQMD"]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    o = s.table("orders").select("o_orderkey", cycle.alias("cycle"), F.to_date("o_orderdate").alias("d"))
    o = o.withColumn("period", X.format_period(F.col("d"), F.col("cycle")))
    o = o.withColumn("obs", X.parse_period(F.col("period"), F.col("cycle")))
    return o.withColumn("back", X.format_period(F.col("obs"), F.col("cycle")))


_WIDE = [n for n, _ in MACRO_SERIES]


@query("series_to_daily_wide", "d:d " + " ".join(f"{n}:9" for n in _WIDE), "macro",
       "SELECT d, " + ", ".join(f"last_value({n} IGNORE NULLS) OVER (ORDER BY d) AS {n}" for n in _WIDE) + """
       FROM (SELECT CAST(unnest(generate_series(min(obs_date), max(obs_date), INTERVAL 1 DAY)) AS DATE) AS d FROM macro)
       LEFT JOIN (SELECT obs_date AS d, """ + ", ".join(f"max(value) FILTER (series = '{n}') AS {n}" for n in _WIDE) + " FROM macro GROUP BY 1) USING (d)")
def _(s):
    return N.series_to_daily_wide(s.macro(), _WIDE)


query("trading_days", "d:d", "cal", "SELECT d FROM cal")(lambda s: K.trading_days(s.index_bars()))
query("to_month_end", "d:d month_end:d", "cal", "SELECT d, last_day(d) AS month_end FROM cal")(lambda s: s.calendar().select("d", X.to_month_end(F.col("d")).alias("month_end")))
query("month_end_trading_days", "rd:d", "rds", "SELECT rd FROM rds")(lambda s: K.month_end_trading_days(s.calendar()))


@query("rebalance_grid", "freq rd:d", "cal", """
    SELECT freq, d AS rd FROM (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM cal), (VALUES ('M'), ('Q'), ('W-FRI')) AS f(freq)
    WHERE (freq = 'M' AND d = last_day(d)) OR (freq = 'Q' AND d = last_day(d) AND month(d) % 3 = 0) OR (freq = 'W-FRI' AND dayofweek(d) = 5)""")
def _(s):
    span = s.calendar().agg(F.min("d").alias("a"), F.max("d").alias("b"))
    parts = [K.rebalance_grid(span, f).select(F.lit(f).alias("freq"), "rd") for f in ("M", "Q", "W-FRI")]
    return parts[0].union(parts[1]).union(parts[2])


@query("latest_completed_session", "session:d previous_month_end:d previous_business_day:d", "cal", """
    SELECT session, e - CASE dayofweek(e) WHEN 6 THEN 1 WHEN 0 THEN 2 ELSE 0 END AS previous_month_end,
      session - CASE dayofweek(session) WHEN 1 THEN 3 WHEN 0 THEN 2 ELSE 1 END AS previous_business_day
    FROM (SELECT session, CAST(date_trunc('month', session) - INTERVAL 1 DAY AS DATE) AS e FROM (SELECT max(d) AS session FROM cal WHERE d <= DATE '2000-07-16'))""")
def _(s):
    last = K.latest_completed_session(s.calendar(), F.lit("2000-07-16").cast("date"))
    return last.select("session", X.previous_month_end(F.col("session")).alias("previous_month_end"), X.previous_business_day(F.col("session")).alias("previous_business_day"))


_FIELDS = {  # what each category reports beyond its receipt
    "treasury_buyback": ["aqpln_prc_ostk"], "capital_increase": ["nstk_ostk_qy", "bdis_pric", "ic_mthn"], "bonus_issue": [], "treasury_sell": ["dppln_prc_ostk"], "convertible_bond": ["bd_fta"], "warrant_bond": ["bd_fta"],
    "insider_holdings": ["bsis_stkqy", "aft_stkqy", "trade_uv"], "major_holders": ["stkrt_irds"], "merger": [], "spinoff": ["div_mth"], "capital_reduction": [],
}
_EVENT = "asset rcept_no rcept_dt:d event_category aqpln_prc_ostk:0 dppln_prc_ostk:0 bd_fta:0 nstk_ostk_qy:0 bdis_pric:2 ic_mthn div_mth bsis_stkqy:0 aft_stkqy:0 trade_uv:2 stkrt_irds:2"


@query("union_events", _EVENT, "disc", "SELECT * FROM disc")
def _(s):
    """One table per category, each with its own columns, stacked again."""
    d = files.materialize(s.disclosures(), "disclosures")
    return N.union_events({c: d.filter(F.col("event_category") == c).select("asset", "rcept_no", "rcept_dt", *cols) for c, cols in _FIELDS.items()})


@query("receipt_date", "rcept_no known:d", "disc", "SELECT rcept_no, rcept_dt AS known FROM disc")
def _(s):
    return s.disclosures().select("rcept_no", X.receipt_date(F.col("rcept_no")).alias("known"))


def _lines(s):
    """Statement lines from the quarterly filings: ids for some issuers, names only for others, with commas."""
    f = s.fundamentals()
    accounts = [("ifrs-full_Revenue", "영업수익", "revenue"), ("dart_OperatingIncomeLoss", "영업이익(손실)", "operating_income"),
                ("ifrs-full_ProfitLoss", "당기순이익", "net_income"), ("ifrs-full_Assets", "자산총계", "total_assets"),
                ("ifrs-full_Equity", "자본총계", "total_equity"), ("ifrs-full_Liabilities", "부채총계", "total_liabilities")]
    by_name = F.col("asset").cast("int") % 3 == 0
    items = [F.struct(F.lit(i).alias("line_no"), F.when(~by_name, F.lit(a)).otherwise("-표준계정코드 미사용-").alias("account_id"),
                      F.lit(n).alias("account_nm"), F.format_number(c, 2).alias("amount_text")) for i, (a, n, c) in enumerate(accounts)]
    return f.select(
        padded(F.col("asset"), 8).alias("corp_code"), "year", "reprt_code", "rcept_dt", F.explode(F.array(*items)).alias("x")
    ).select("corp_code", "year", "reprt_code", "rcept_dt", "x.line_no", "x.account_id", "x.account_nm", X.parse_number(F.col("x.amount_text")).alias("amount"))


@query("extract_accounts", "corp_code year:i reprt_code revenue:2 operating_income:2 net_income:2 total_assets:2 total_equity:2 total_liabilities:2 operating_cash_flow:2", "fund",
       "SELECT lpad(asset, greatest(8, length(asset))::INT, '0') AS corp_code, *, NULL AS operating_cash_flow FROM fund")
def _(s):
    return N.extract_accounts(_lines(s), ["corp_code", "year", "reprt_code"])


@query("quarterly_panel", "corp_code year:i reprt_code period_end:d rcept_dt:d revenue:2 net_income:2 total_equity:2", "fund", "SELECT lpad(asset, greatest(8, length(asset))::INT, '0') AS corp_code, * FROM fund")
def _(s):
    return N.quarterly_panel(_lines(s))


def _corp_map(s):
    return s.assets().filter(F.col("exchange") == "KOSPI").select(padded(F.col("asset"), 8).alias("corp_code"), "asset", "name")


@query("map_corp_to_asset", "corp_code year:i reprt_code asset", "fund assets",
       "SELECT lpad(f.asset, greatest(8, length(f.asset))::INT, '0') AS corp_code, year, reprt_code, CASE WHEN exchange = 'KOSPI' THEN f.asset END AS asset FROM fund f JOIN assets a ON f.asset = a.asset")
def _(s):
    panel = s.fundamentals().select(padded(F.col("asset"), 8).alias("corp_code"), "year", "reprt_code")
    return N.map_corp_to_asset(panel, _corp_map(s))


@query("enrich_name", "asset rd:d name", "keys assets", "SELECT k.asset, rd, CASE WHEN exchange = 'KOSPI' THEN name ELSE '' END AS name FROM keys k JOIN assets a ON k.asset = a.asset")
def _(s):
    return N.enrich_name(s.keys(), _corp_map(s))


@query("append_dedup", "asset rcept_dt:d rcept_no event_category", "disc", """
    SELECT asset, rcept_dt, max(rcept_no) AS rcept_no, arg_max(event_category, rcept_no) AS event_category FROM disc WHERE rcept_dt < DATE '1996-07-01' GROUP BY 1, 2 UNION ALL
    SELECT asset, rcept_dt, max(rcept_no), arg_max(event_category, rcept_no) FROM disc WHERE rcept_dt >= DATE '1996-07-01' GROUP BY 1, 2""")
def _(s):
    """A store of the first years, to which all events from half a year before its end on are added."""
    d, key = s.disclosures().select("asset", "rcept_dt", "rcept_no", "event_category"), ["asset", "rcept_dt"]
    old = N.keep_last(d.filter("rcept_dt < date'1996-07-01'"), key, [F.col("rcept_no")])
    return N.append_dedup(old, d.filter("rcept_dt >= date'1996-01-01'"), key, [F.col("rcept_no")])


@query("corp_map_coverage", "n_rows:i n_mapped:i n_issuers:i n_issuers_mapped:i", "fund assets", """
    SELECT count(*) AS n_rows, count(*) FILTER (exchange = 'KOSPI') AS n_mapped, count(DISTINCT f.asset) AS n_issuers, count(DISTINCT f.asset) FILTER (exchange = 'KOSPI') AS n_issuers_mapped FROM fund f JOIN assets a ON f.asset = a.asset""")
def _(s):
    panel = s.fundamentals().select(padded(F.col("asset"), 8).alias("corp_code"), "year", "reprt_code")
    return N.corp_coverage(N.map_corp_to_asset(panel, _corp_map(s)))


@query("frame_digest", "asset n:i digest", "bars", "SELECT asset, count(*) AS n, sha256(string_agg(CAST(d AS VARCHAR) || '=' || CAST(CAST(round(close * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY d)) AS digest FROM bars GROUP BY 1")
def _(s):
    return N.frame_digest(s.bars(), "asset", "d", "close")
