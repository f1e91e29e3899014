"""Point-in-time joins, snapshot universes, predicates and set operations."""

from pyspark.sql import functions as F

from panelspark.catalog.registry import add_cte, query
from panelspark.functions import feature_groups as G, scalars as X
from panelspark.functions.rolling import series
from panelspark.operators import asof as A, hygiene as H, universe as U, xsection as XS
from panelspark.sources.files import materialize
from panelspark.sources.normalize import keep_last

CFG = U.Eligibility(min_trading_value=2.2e6, min_market_cap=8e11, min_listed_months=12)

add_cte("hist", "presence", """
    SELECT asset, sum(c) AS n_appearances, min(a) AS first_seen_date, max(b) AS last_seen_date, arg_min(market, (-c, market)) AS market,
      max(b) = (SELECT max(snapshot_date) FROM presence) AS is_active_latest, min(a) = (SELECT min(snapshot_date) FROM presence) AS lower_bound
    FROM (SELECT asset, market, count(*) AS c, min(snapshot_date) AS a, max(snapshot_date) AS b FROM presence GROUP BY 1, 2) GROUP BY 1""")


@query("listing_history", "asset market n_appearances:i first_seen_date:d last_seen_date:d is_active_latest inferred_listing_date:d inferred_delisting_date:d listing_date_is_lower_bound", "hist", """
    SELECT *, first_seen_date AS inferred_listing_date, CASE WHEN NOT is_active_latest THEN last_seen_date END AS inferred_delisting_date, lower_bound AS listing_date_is_lower_bound FROM hist""")
def _(s):
    return U.listing_history(s.presence())


@query("listed_months", "asset snapshot_date:d listed_months:0 listing_date_known", "hist", """
    SELECT p.asset, p.snapshot_date, CASE WHEN NOT lower_bound THEN round_even(datediff('day', first_seen_date, p.snapshot_date) / 30.4375::DOUBLE, 0) END AS listed_months,
      NOT lower_bound AS listing_date_known FROM presence p JOIN hist h USING (asset)""")
def _(s):
    p = s.presence()
    keys = p.select("asset", F.col("snapshot_date").alias("rd"))
    return U.listed_months(U.listing_history(p), keys).withColumnRenamed("rd", "snapshot_date")


add_cte("atv", "keys bars", """
    SELECT k.asset, k.rd, b.v AS avg_trading_value_60d, b.n AS days_observed FROM keys k ASOF LEFT JOIN
      (SELECT asset, d, avg(value) OVER w AS v, count(value) OVER w AS n FROM bars WINDOW w AS (PARTITION BY asset ORDER BY d ROWS 59 PRECEDING)) b
      ON k.asset = b.asset AND k.rd >= b.d""")


@query("avg_trading_value", "asset rd:d avg_trading_value_60d:4 days_observed:0", "atv", "SELECT * FROM atv")
def _(s):
    return U.avg_trading_value(s.bars(), s.keys())


add_cte("memb", "listed rds", """
    SELECT r.rd, l.* FROM (SELECT rd, (SELECT max(snapshot_date) FROM listed WHERE snapshot_date <= rd) AS sd FROM rds) r JOIN listed l ON l.snapshot_date = r.sd""")
add_cte("univ", "memb listed bars assets", """
    SELECT m.asset, m.rd, m.market, m.market_cap, avg_trading_value_60d, days_observed, name, exchange, sector, group_flag, industry, lm AS listed_months,
      CASE WHEN regexp_matches(m.asset, '^\\d{5}[579]$') THEN 'preferred' WHEN name ILIKE '%SPAC%' THEN 'spac' WHEN name ILIKE '%REIT%' THEN 'reit'
        WHEN coalesce(avg_trading_value_60d, 0) < 2.2e6 THEN 'low_trading_value' WHEN coalesce(m.market_cap, 0) < 8e11 THEN 'low_market_cap'
        WHEN coalesce(lm, 0) < 12 THEN 'too_new' ELSE '' END AS exclude_reason
    FROM memb m ASOF LEFT JOIN (SELECT asset, d, avg(value) OVER w AS avg_trading_value_60d, count(value) OVER w AS days_observed FROM bars WINDOW w AS (PARTITION BY asset ORDER BY d ROWS 59 PRECEDING)) a
      ON a.asset = m.asset AND m.rd >= a.d JOIN assets s ON s.asset = m.asset
    LEFT JOIN (SELECT p.asset, p.rd, CASE WHEN f > (SELECT min(snapshot_date) FROM listed) THEN round_even(datediff('day', f, p.rd) / 30.4375::DOUBLE, 0) END AS lm
               FROM memb p JOIN (SELECT asset, min(snapshot_date) AS f FROM listed GROUP BY 1) USING (asset)) l ON l.asset = m.asset AND l.rd = m.rd""")


def universe(s, cfg=CFG):
    return U.universe_panel(materialize(s.listed(), "snapshots"), s.bars(), s.assets(), s.month_ends().select("rd"), cfg)


@query("universe_snapshot", "asset rd:d market market_cap:0 name avg_trading_value_60d:4 days_observed:0 listed_months:0 exclude_reason eligible", "univ",
       "SELECT *, exclude_reason = '' AS eligible FROM univ")
def _(s):
    return universe(s)


@query("apply_eligibility", "asset rd:d exclude_reason eligible", "mcap atv assets", """
    SELECT m.asset, m.snapshot_date AS rd, CASE WHEN name ILIKE '%SPAC%' THEN 'spac' WHEN coalesce(avg_trading_value_60d, 0) < 2e6 THEN 'low_trading_value'
      WHEN coalesce(market_cap, 0) < 8e11 THEN 'low_market_cap' WHEN month(m.snapshot_date) < 3 THEN 'too_new' ELSE '' END AS exclude_reason, exclude_reason = '' AS eligible
    FROM mcap m JOIN atv a ON a.asset = m.asset AND a.rd = m.snapshot_date JOIN assets s ON s.asset = m.asset""")
def _(s):
    m = s.mcap().withColumnRenamed("snapshot_date", "rd")
    df = (m.join(U.avg_trading_value(s.bars(), m.select("asset", "rd")), ["asset", "rd"]).join(s.assets().select("asset", "name"), "asset")
          .withColumn("listed_months", F.when(F.month("rd") > 1, F.month("rd"))))
    return U.apply_eligibility(df, U.Eligibility(2e6, 8e11, 3, exclude_preferred=False, exclude_reits=False))


query("name_flags", "asset preferred:b spac:b reit:b", "assets",
      "SELECT asset, regexp_matches(asset, '^\\d{5}[579]$') AS preferred, name LIKE '%SPAC%' AS spac, name LIKE '%REIT%' AS reit FROM assets")(
    lambda s: s.assets().select("asset", U.is_preferred(F.col("asset")).alias("preferred"), U.is_spac(F.col("name")).alias("spac"), U.is_reit(F.col("name")).alias("reit")))
query("filter_market", "asset snapshot_date:d market", "mcap", "SELECT * FROM mcap WHERE market = 'KOSDAQ'")(lambda s: U.filter_market(s.mcap(), ["kosdaq"]))
query("mcap_band", "asset snapshot_date:d market_cap:0", "mcap", "SELECT * FROM mcap WHERE market_cap BETWEEN 5e11 AND 2e12")(lambda s: U.mcap_band(s.mcap(), 5e11, 2e12))
query("universe_order", "asset rd:d eligible market_cap:0", "univ", "SELECT *, exclude_reason = '' AS eligible FROM univ ORDER BY eligible DESC, market_cap DESC, asset")(
    lambda s: universe(s).orderBy(F.desc("eligible"), F.desc("market_cap"), "asset"))

_GOV = G.GROUPS["regime"]


@query("disabled_feature_group", "asset rd:d ret_12_1m:2 per:2 macro_vix:2 vkospi_above_25 stage_label regime_label_kr regime_sleeve_multiplier_core:2 kospi_above:s governance_risk_score:2", "keys", """
    SELECT asset, rd, 0.0 AS ret_12_1m, 0.0 AS per, CAST(NULL AS DOUBLE) AS macro_vix, false AS vkospi_above_25, 'unknown' AS stage_label, 'unknown' AS regime_label_kr,
      1.0 AS regime_sleeve_multiplier_core, CAST(NULL AS VARCHAR) AS kospi_above, 0.0 AS governance_risk_score FROM keys""")
def _(s):
    df = s.keys()
    for g in G.GROUPS:
        df = G.with_feature_group(df, g, enabled=False)
    return df.withColumn("kospi_above", F.col("kospi_above_ma200").cast("string"))


@query("hard_sanitize", "o_orderkey:i x:4", "", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END AS x FROM orders")
def _(s):
    k = F.col("o_orderstatus")
    df = s.table("orders").select("o_orderkey", F.when(k == "O", F.col("o_totalprice")).when(k == "P", F.lit(float("nan"))).otherwise(F.lit(float("-inf"))).alias("x"))
    return H.hard_sanitize(df, ["x"])


query("safe_div", "o_orderkey:i x:6", "", "SELECT o_orderkey, CASE WHEN abs(o_custkey % 5) > 1e-3 THEN o_totalprice / (o_custkey % 5) END AS x FROM orders")(
    lambda s: s.table("orders").select("o_orderkey", X.safe_div(F.col("o_totalprice"), (F.col("o_custkey") % 5).cast("double")).alias("x")))
query("normalize_asset", "o_orderkey:i asset", "", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'X' || o_custkey ELSE lpad(CAST(o_custkey AS VARCHAR), greatest(6, length(CAST(o_custkey AS VARCHAR)))::INT, '0') END AS asset FROM orders")(
    lambda s: s.table("orders").select("o_orderkey", X.normalize_asset(F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("X"), F.col("o_custkey").cast("string"))).otherwise(F.col("o_custkey").cast("string"))).alias("asset")))
query("coerce_numbers", "o_orderkey:i x:2 n:i", "", "SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN -1 ELSE o_totalprice END AS x, CASE o_orderstatus WHEN 'P' THEN 7 ELSE CAST(trunc(o_totalprice) AS BIGINT) END AS n FROM orders")(
    lambda s: s.table("orders").withColumn("t", F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.col("o_totalprice").cast("string")))
    .select("o_orderkey", X.to_double(F.col("t"), -1.0).alias("x"), X.to_int(F.col("t"), 7).alias("n")))


@query("pit_visible", "asset rd:d n_visible:i latest:d", "keys fund", "SELECT k.asset, rd, count(rcept_dt) AS n_visible, max(rcept_dt) AS latest FROM keys k LEFT JOIN fund f ON k.asset = f.asset AND rcept_dt <= rd GROUP BY 1, 2")
def _(s):
    """Filings known at each key: how many and the latest; keys without any keep 0."""
    counted = H.window_counts(s.fundamentals(), s.keys(), "rcept_dt", {"n_visible": None})
    known = H.pit_visible(A.asof(s.keys(), s.fundamentals().select("asset", "rcept_dt", F.col("rcept_dt").alias("latest")), ["asset"], "rd", "rcept_dt", ["latest"]), "latest", "rd")
    return counted.join(known.select("asset", "rd", "latest"), ["asset", "rd"], "left")


@query("lookback_windows", "asset rd:d n_months:i n_days:i", "keys disc", """
    SELECT k.asset, rd, count(*) FILTER (rcept_dt > CAST(rd - INTERVAL 3 MONTH AS DATE)) AS n_months, count(*) FILTER (rcept_dt >= rd - 90) AS n_days
    FROM keys k LEFT JOIN disc d ON k.asset = d.asset AND rcept_dt <= rd GROUP BY 1, 2""")
def _(s):
    return H.window_counts(s.disclosures(), s.keys(), "rcept_dt", {"n_months": F.add_months("rd", -3), "n_days": F.date_sub("rd", 91)})


_DCOLS = ["aqpln_prc_ostk", "dppln_prc_ostk", "bd_fta", "nstk_ostk_qy", "bdis_pric", "bsis_stkqy", "aft_stkqy", "trade_uv", "stkrt_irds"]
_RATES = " UNION ALL ".join(f"SELECT '{c}' AS feature, avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0 END) AS null_rate FROM disc" for c in _DCOLS)

query("select_feature_columns", "feature null_rate:6 selected", "disc", f'SELECT *, null_rate <= 0.9 AS selected FROM ({_RATES})')(lambda s: H.select_feature_columns(s.disclosures(), set(), 0.9))
query("coverage_report", "feature coverage:6", "disc", f'SELECT feature, 1 - null_rate AS coverage FROM ({_RATES})')(lambda s: H.coverage_report(s.disclosures(), _DCOLS))
query("labelled_only", "doc_id:i label:i", "", "SELECT doc_id, quality AS label FROM labels WHERE toxic = 0")(
    lambda s: H.labelled_only(s.table("labels").select("doc_id", F.when(F.col("toxic") == 0, F.col("quality")).alias("label"))))
query("align_features", "asset d:d volume:2 close:6 missing_a:1", "bars", "SELECT asset, d, volume, close, 0.0 AS missing_a FROM bars")(
    lambda s: H.align_features(s.bars(), ["volume", "missing_a", "close"], ["asset", "d"])[0])
query("assert_complete", "asset d:d close:6", "bars", "SELECT asset, d, close FROM bars")(lambda s: H.assert_complete(s.bars(), ["close", "volume"]))


@query("strict_violations", "asset code n:i", "bars", """
    SELECT asset, 'non_positive_close' AS code, count(*) AS n FROM bars WHERE volume < 3 GROUP BY 1 UNION ALL
    SELECT asset, 'missing_close', count(*) FROM bars WHERE volume >= 3 AND volume < 5 GROUP BY 1 UNION ALL
    SELECT asset, 'duplicate_date', count(*) FROM bars WHERE volume > 95 GROUP BY 1""")
def _(s):
    b, v = s.bars(), F.col("volume")
    p = F.when(v < 3, F.lit(-1.0)).when(v < 5, F.lit(float("nan"))).otherwise(F.col("close"))
    df = b.select("asset", "d", F.explode(F.when(v > 95, F.array(p, p)).otherwise(F.array(p))).alias("close"))
    return H.strict_violations(df, "asset")


query("registry_gaps", "asset n:i", "assets", "SELECT asset, CASE sector WHEN 'S0' THEN 0 ELSE 2 END AS n FROM assets WHERE sector IN ('S0', 'S1')")(
    lambda s: H.registry_gaps(s.assets().filter(F.col("sector") != "S0").select("asset", F.explode(F.sequence(F.lit(1), F.when(F.col("sector") == "S1", 2).otherwise(1))).alias("x")), s.assets(), "asset"))
query("sign_flips", "asset d:d pos:0 neg:0", "flow", """
    SELECT asset, d, CASE WHEN p < 0 AND foreign_net > 0 THEN 1 ELSE 0 END AS pos, CASE WHEN p > 0 AND foreign_net < 0 THEN 1 ELSE 0 END AS neg
    FROM (SELECT *, lag(foreign_net) OVER (PARTITION BY asset ORDER BY d) AS p FROM flow)""")(
    lambda s: s.flow().withColumn("p", F.lag("foreign_net").over(series("asset"))).select("asset", "d", X.sign_flip_pos(F.col("p"), F.col("foreign_net")).alias("pos"), X.sign_flip_neg(F.col("p"), F.col("foreign_net")).alias("neg")))





# joins -----------------------------------------------------------------------------------------
query("left_enrich", "asset d:d name market_note", "bars assets", "SELECT b.asset, d, name, CASE WHEN sector = 'S2' THEN exchange END AS market_note FROM bars b JOIN assets a USING (asset)")(
    lambda s: s.bars().select("asset", "d").join(s.assets().select("asset", "name"), "asset", "left").join(s.assets().filter(F.col("sector") == "S2").select("asset", F.col("exchange").alias("market_note")), "asset", "left"))


@query("outer_align", "d:d close:6 usd_krw:9 foreign_net:2", "mkt macro mflow", """
    SELECT d, close, usd_krw, foreign_net FROM (SELECT d, close FROM mkt) FULL JOIN (SELECT obs_date AS d, value AS usd_krw FROM macro WHERE series = 'usd_krw') USING (d)
    FULL JOIN (SELECT d, foreign_net FROM mflow WHERE market = 'KOSPI') USING (d)""")
def _(s):
    fx = s.macro().filter(F.col("series") == "usd_krw").select(F.col("obs_date").alias("d"), F.col("value").alias("usd_krw"))
    fl = s.investor_flow().filter(F.col("market") == "KOSPI").groupBy("d").agg(F.coalesce(F.max(F.when(F.col("investor") == "foreign", F.col("net"))), F.lit(0.0)).alias("foreign_net"))
    return A.outer_align([s.market().select("d", "close"), fx, fl])


@query("asof_close", "asset rd:d close:6 bar_date:d", "keys bars", "SELECT k.asset, k.rd, b.close, b.d AS bar_date FROM keys k ASOF LEFT JOIN bars b ON k.asset = b.asset AND k.rd >= b.d")
def _(s):
    return A.asof(s.keys(), s.bars(), ["asset"], "rd", "d", ["close"], seen="bar_date")


@query("asof_mcap", "asset rcept_no market_cap:0", "disc mcap", "SELECT d.asset, rcept_no, m.market_cap FROM disc d ASOF LEFT JOIN mcap m ON d.asset = m.asset AND d.rcept_dt >= m.snapshot_date")
def _(s):
    return A.asof(s.disclosures().select("asset", "rcept_no", "rcept_dt"), s.mcap(), ["asset"], "rcept_dt", "snapshot_date", ["market_cap"])


@query("asof_snapshot", "rd:d snapshot_date:d asset market", "rds presence", """
    SELECT rd, p.snapshot_date, asset, market FROM (SELECT rd, (SELECT max(snapshot_date) FROM presence WHERE snapshot_date <= rd) AS sd FROM rds) JOIN presence p ON p.snapshot_date = sd""")
def _(s):
    return A.asof_snapshot(s.presence(), s.month_ends().select("rd"))


LAGS = {"kr_pmi": 1, "consumer_sentiment": 20, "business_sentiment": 25, "kr_industrial_prod": 30, "kr_export_yoy": 5}
_LAGSQL = "CASE series " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LAGS.items()) + " ELSE 0 END"


@query("asof_with_lag", "series rd:d value:9 obs_date:d", "macro rds", f"""
    SELECT n.series, n.rd, m.value, m.obs_date FROM (SELECT DISTINCT series, rd FROM macro, rds) n
    ASOF LEFT JOIN (SELECT *, obs_date + {_LAGSQL} AS known FROM macro) m ON n.series = m.series AND n.rd >= m.known""")
def _(s):
    return A.asof_with_lag(s.macro(), s.month_ends().select("rd"), LAGS)


@query("asof_row", "rd:d close:6 volume:2 d:d", "rds mkt", "SELECT rd, close, volume, d FROM (SELECT rd + 1 AS rd FROM rds) ASOF LEFT JOIN mkt ON rd >= d")
def _(s):
    one = F.lit(1).alias("g")
    return A.asof(s.month_ends().select(F.date_add("rd", 1).alias("rd"), one), s.market().select("*", one), ["g"], "rd", "d", ["close", "volume", "d"])


query("lookup_exact", "asset rd:d market_cap:0", "keys mcap", "SELECT k.asset, k.rd, CASE WHEN month(k.rd) = 6 THEN market_cap END AS market_cap FROM keys k JOIN mcap m ON k.asset = m.asset AND k.rd = m.snapshot_date")(
    lambda s: s.keys().join(s.mcap().filter(F.month("snapshot_date") == 6).select("asset", F.col("snapshot_date").alias("rd"), "market_cap"), ["asset", "rd"], "left"))
query("semi_join", "asset d:d", "bars assets", "SELECT asset, d FROM bars WHERE asset IN (SELECT asset FROM assets WHERE sector = 'S2')")(
    lambda s: s.bars().join(s.assets().filter(F.col("sector") == "S2"), "asset", "left_semi"))
query("anti_join", "asset d:d", "bars assets", "SELECT asset, d FROM bars WHERE asset NOT IN (SELECT asset FROM assets WHERE sector = 'S2')")(
    lambda s: s.bars().join(s.assets().filter(F.col("sector") == "S2"), "asset", "left_anti"))
query("map_labels", "asset label", "", "SELECT lpad(CAST(s_suppkey AS VARCHAR), greatest(6, length(CAST(s_suppkey AS VARCHAR)))::INT, '0') AS asset, n_name AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey")(
    lambda s: s.assets().join(s.table("nation").select(F.col("n_nationkey").alias("industry"), F.col("n_name").alias("label")), "industry", "left"))

# sets ------------------------------------------------------------------------------------------
_EARLY, _LATE = "SELECT asset FROM presence WHERE year(snapshot_date) = 1996", "SELECT asset FROM presence WHERE year(snapshot_date) = 2001"


def _sets(s):
    p = s.presence()
    return [p.filter(F.year("snapshot_date") == y).select("asset") for y in (1996, 2001)]


query("set_union", "asset", "presence", f"{_EARLY} UNION {_LATE}")(lambda s: _sets(s)[0].union(_sets(s)[1]).distinct())
query("set_intersect", "asset", "presence", f"{_EARLY} INTERSECT {_LATE}")(lambda s: _sets(s)[0].intersect(_sets(s)[1]))
query("set_except", "asset", "presence", f"SELECT * FROM ({_EARLY}) EXCEPT SELECT * FROM ({_LATE})")(lambda s: _sets(s)[0].distinct().exceptAll(_sets(s)[1].distinct()))
query("symmetric_difference", "asset", "presence", f"(({_EARLY}) EXCEPT ({_LATE})) UNION (({_LATE}) EXCEPT ({_EARLY}))")(
    lambda s: (lambda a, b: a.exceptAll(b).union(b.exceptAll(a)))(*[x.distinct() for x in _sets(s)]))
query("distinct_by_key", "asset snapshot_date:d", "presence", "SELECT asset, max(snapshot_date) AS snapshot_date FROM presence GROUP BY 1")(
    lambda s: keep_last(s.presence(), ["asset"], [F.col("snapshot_date")]))
query("union_all_frames", "src asset d:d", "bars flow", "SELECT 'bars' AS src, asset, d FROM bars UNION ALL SELECT 'flow', asset, d FROM flow")(
    lambda s: s.bars().select(F.lit("bars").alias("src"), "asset", "d").unionByName(s.flow().select(F.lit("flow").alias("src"), "asset", "d")))
