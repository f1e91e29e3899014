"""Fundamentals, disclosure events, governance."""

from pyspark.sql import functions as F

from panelspark.catalog.registry import add_cte, query
from panelspark.catalog.xsection import z_sql
from panelspark.operators import events as E, fundamental as FU

add_cte("vis", "keys funda", "SELECT k.rd, f.*, CASE reprt_code WHEN '11013' THEN 4.0 WHEN '11012' THEN 2.0 WHEN '11014' THEN 4.0::DOUBLE / 3 ELSE 1.0 END::DOUBLE AS fct FROM keys k JOIN funda f ON k.asset = f.asset AND f.rcept_dt <= k.rd")
add_cte("ttm", "keys vis", """
    SELECT k.asset, k.rd, l.total_assets, l.total_equity, l.total_liabilities, l.revenue * l.fct AS revenue_ttm, l.operating_income * l.fct AS operating_income_ttm, l.net_income * l.fct AS net_income_ttm,
      l.period_end AS fundamentals_period_end, l.rcept_dt AS fundamentals_rcept_dt, l.reprt_code AS fundamentals_reprt_code,
      CASE WHEN abs(p.revenue) > 1e-3 THEN (l.revenue - p.revenue) / abs(p.revenue) END AS revenue_growth_yoy, CASE WHEN abs(p.operating_income) > 1e-3 THEN (l.operating_income - p.operating_income) / abs(p.operating_income) END AS operating_income_growth_yoy,
      CASE WHEN abs(p.net_income) > 1e-3 THEN (l.net_income - p.net_income) / abs(p.net_income) END AS net_income_growth_yoy
    FROM keys k LEFT JOIN (SELECT * FROM vis QUALIFY row_number() OVER (PARTITION BY asset, rd ORDER BY period_end DESC, rcept_dt DESC) = 1) l ON l.asset = k.asset AND l.rd = k.rd
    LEFT JOIN (SELECT * FROM vis QUALIFY row_number() OVER (PARTITION BY asset, rd, year, reprt_code ORDER BY rcept_dt DESC) = 1) p ON p.asset = l.asset AND p.rd = l.rd AND p.year = l.year - 1 AND p.reprt_code = l.reprt_code""")
_TTM = "total_assets:2 total_equity:2 total_liabilities:2 revenue_ttm:4 operating_income_ttm:4 net_income_ttm:4 fundamentals_period_end:d fundamentals_rcept_dt:d fundamentals_reprt_code revenue_growth_yoy:6 operating_income_growth_yoy:6 net_income_growth_yoy:6"
query("ttm_features", f"asset rd:d {_TTM}", "ttm", "SELECT * FROM ttm")(lambda s: FU.ttm_features(s.fundamentals(amended=True), s.keys()))
query("yoy_growth", "asset rd:d revenue_growth_yoy:6 net_income_growth_yoy:6", "ttm", "SELECT * FROM ttm")(lambda s: FU.ttm_features(s.fundamentals(amended=True), s.keys()))
query("ttm_legacy_order", "asset rd:d fundamentals_bsns_year:0 fundamentals_reprt_code revenue_ttm:4", "keys vis", """
    SELECT k.asset, k.rd, l.year AS fundamentals_bsns_year, l.reprt_code AS fundamentals_reprt_code, l.revenue * l.fct AS revenue_ttm
    FROM keys k LEFT JOIN (SELECT * FROM vis QUALIFY row_number() OVER (PARTITION BY asset, rd ORDER BY year DESC, reprt_code DESC, rcept_dt DESC) = 1) l ON l.asset = k.asset AND l.rd = k.rd""")(
    lambda s: FU.ttm_features(s.fundamentals(amended=True), s.keys(), legacy_order=True))

SCALE = 100000.0  # filings of the fixture are small against market capitalisation
add_cte("val", "mcap ttm", f"""
    SELECT m.asset, m.snapshot_date AS rd, market_cap / nullif(net_income_ttm * {SCALE}, 0) AS per, market_cap / nullif(total_equity * {SCALE}, 0) AS pbr, greatest(net_income_ttm, 0) * {SCALE} * 0.2 / market_cap * 100 AS dividend_yield
    FROM mcap m JOIN ttm t ON t.asset = m.asset AND t.rd = m.snapshot_date""")


def valuations(s):
    t = FU.ttm_features(s.fundamentals(amended=True), s.keys())
    m = s.mcap().withColumnRenamed("snapshot_date", "rd").join(t, ["asset", "rd"])
    c = F.col
    zero_null = lambda x: F.nullif(x * SCALE, F.lit(0.0))
    dy = F.when(c("net_income_ttm").isNotNull(), F.greatest(c("net_income_ttm"), F.lit(0.0)) * SCALE * 0.2 / c("market_cap") * 100)
    return m.select("asset", "rd", (c("market_cap") / zero_null(c("net_income_ttm"))).alias("per"), (c("market_cap") / zero_null(c("total_equity"))).alias("pbr"), dy.alias("dividend_yield"))


query("valuation_snapshot", "asset rd:d per:4 pbr:4 dividend_yield:6", "val", "SELECT asset, rd, per, pbr, CASE WHEN per IS NOT NULL OR pbr IS NOT NULL THEN dividend_yield END AS dividend_yield FROM val")(
    lambda s: FU.valuation_snapshot(s.keys(), valuations(s)))

add_cte("rat", "keys ttm val", """
    SELECT k.asset, k.rd, t.* EXCLUDE (asset, rd), CASE WHEN abs(total_equity) > 1e-3 THEN net_income_ttm / total_equity END AS roe, CASE WHEN abs(total_assets) > 1e-3 THEN net_income_ttm / total_assets END AS roa,
      CASE WHEN abs(revenue_ttm) > 1e-3 THEN operating_income_ttm / revenue_ttm END AS operating_margin, CASE WHEN abs(revenue_ttm) > 1e-3 THEN net_income_ttm / revenue_ttm END AS net_margin,
      CASE WHEN abs(total_equity) > 1e-3 THEN total_liabilities / total_equity END AS debt_to_equity, v.per, v.pbr, CASE WHEN v.per IS NOT NULL OR v.pbr IS NOT NULL THEN v.dividend_yield END AS dividend_yield
    FROM keys k JOIN ttm t ON t.asset = k.asset AND t.rd = k.rd LEFT JOIN val v ON v.asset = k.asset AND v.rd = k.rd""")
add_cte("rng", "rat", """
    SELECT *, CASE WHEN per > 0 AND per < 200 THEN per END AS per_r, CASE WHEN pbr > 0 AND pbr < 50 THEN pbr END AS pbr_r, CASE WHEN roe > -1 AND roe < 1 THEN roe END AS roe_r,
      CASE WHEN operating_margin > -1 AND operating_margin < 1 THEN operating_margin END AS om_r, CASE WHEN debt_to_equity > 0 THEN debt_to_equity END AS de_r FROM rat""")
_ZC = {"per": "per_r", "pbr": "pbr_r", "dy": "dividend_yield", "og": "operating_income_growth_yoy", "roe": "roe_r", "om": "om_r", "de": "de_r"}
add_cte("fin", "rng", "SELECT r.*, " + ", ".join(f"coalesce(z_{k}.z, 0) AS zz_{k}" for k in _ZC) + " FROM rng r " + " ".join(f"JOIN {z_sql('rng', c)} z_{k} ON z_{k}.asset = r.asset AND z_{k}.rd = r.rd" for k, c in _ZC.items()))
add_cte("ff", "fin", """
    SELECT asset, rd, coalesce(roe, 0) AS roe, coalesce(roa, 0) AS roa, coalesce(operating_margin, 0) AS operating_margin, coalesce(net_margin, 0) AS net_margin, coalesce(debt_to_equity, 0) AS debt_to_equity,
      (-0.4 * zz_per - 0.3 * zz_pbr + 0.2 * zz_dy + 0.1 * zz_og) / (0.4::DOUBLE + 0.3 + 0.2 + 0.1) AS value_score, (0.4 * zz_roe + 0.35 * zz_om - 0.25 * zz_de) / 1.0 AS quality_score,
      CASE WHEN operating_income_ttm > 0 THEN 0.4 ELSE 0 END + CASE WHEN net_income_ttm > 0 THEN 0.2 ELSE 0 END + 0.4 * (CASE WHEN operating_income_growth_yoy > 0.5 THEN 1 ELSE 0 END - 0.5) AS turnaround_score FROM fin""")


def features(s):
    return FU.fundamental_features(FU.valuation_snapshot(s.keys(), valuations(s)), s.fundamentals(amended=True))


query("fundamental_features", "asset rd:d roe:6 roa:6 operating_margin:6 net_margin:6 debt_to_equity:6", "ff", "SELECT * FROM ff")(features)
query("value_score", "asset rd:d value_score:6", "ff", "SELECT * FROM ff")(features)
query("quality_score", "asset rd:d quality_score:6", "ff", "SELECT * FROM ff")(features)
query("turnaround_score", "asset rd:d turnaround_score:6", "ff", "SELECT * FROM ff")(features)

# events ----------------------------------------------------------------------------------------
add_cte("ev", "mcap disc", """
    SELECT m.asset, m.snapshot_date AS rd, any_value(m.market_cap) AS mc, """ + ", ".join([
    "coalesce(sum(aqpln_prc_ostk), 0)::DOUBLE AS buy", "coalesce(sum(dppln_prc_ostk), 0)::DOUBLE AS sell", "coalesce(sum(bd_fta) FILTER (event_category = 'convertible_bond'), 0)::DOUBLE AS cb",
    "coalesce(sum(bd_fta) FILTER (event_category = 'warrant_bond'), 0)::DOUBLE AS bw", "coalesce(sum(nstk_ostk_qy::DECIMAL(12,0) * bdis_pric), 0)::DOUBLE AS dil", "coalesce(sum((aft_stkqy - bsis_stkqy)::DECIMAL(12,0) * trade_uv), 0)::DOUBLE AS ins",
    "coalesce(sum(stkrt_irds), 0)::DOUBLE AS stk", "count(*) FILTER (event_category = 'bonus_issue') AS n_bonus", "count(*) FILTER (event_category = 'spinoff') AS n_spin", "count(*) FILTER (event_category = 'capital_reduction') AS n_cr"]) + """
    FROM mcap m LEFT JOIN disc d ON d.asset = m.asset AND d.rcept_dt BETWEEN m.snapshot_date - 90 AND m.snapshot_date GROUP BY 1, 2""")
add_cte("evs", "ev", """
    SELECT *, a + b + c + e + f + g + h + i + j + k AS disclosure_event_total_score FROM (SELECT asset, rd, 0.5 * least(1, buy / mc / 0.02) AS a, -0.4 * least(1, dil / mc / 0.05) AS b, CASE WHEN n_bonus > 0 THEN 0.3 ELSE 0 END AS c,
      -0.3 * least(1, sell / mc / 0.02) AS e, -0.2 * least(1, cb / mc / 0.1) AS f, -0.2 * least(1, bw / mc / 0.1) AS g, 0.3 * greatest(-1, least(1, ins / mc / 0.005)) AS h, 0.25 * greatest(-1, least(1, stk)) AS i,
      CASE WHEN n_spin > 0 THEN -0.15 ELSE 0 END AS j, CASE WHEN n_cr > 0 THEN -0.4 ELSE 0 END AS k FROM ev)""")


def event_universe(s):
    return s.mcap().withColumnRenamed("snapshot_date", "rd").join(s.assets().select("asset", "group_flag"), "asset")


_EV = {"a": "treasury_buyback", "b": "capital_increase", "c": "bonus_issue", "e": "treasury_sell", "f": "convertible_bond", "g": "warrant_bond", "h": "insider_holdings", "i": "major_holders", "j": "spinoff", "k": "capital_reduction"}
query("event_scores", "asset rd:d " + " ".join(f"event_{c}_score:6" for c in E.CATALOG) + " disclosure_event_total_score:6", "evs",
      "SELECT asset, rd, " + ", ".join(f"{k} AS event_{c}_score" for k, c in _EV.items()) + ", 0 AS event_merger_score, disclosure_event_total_score FROM evs")(lambda s: E.event_scores(s.disclosures(), event_universe(s)))
for _name, _col, _key in [("event_amount_pct_mcap", "event_treasury_buyback_score", "a"), ("event_computed_dilution", "event_capital_increase_score", "b"), ("event_binary", "event_bonus_issue_score", "c"),
                          ("event_insider_net_buy", "event_insider_holdings_score", "h"), ("event_stake_change", "event_major_holders_score", "i")]:
    query(_name, f"asset rd:d {_col}:6", "evs", f"SELECT asset, rd, {_key} AS {_col} FROM evs")(lambda s: E.event_scores(s.disclosures(), event_universe(s)))


@query("disclosure_features", "asset rd:d disclosure_event_total_score:6 event_merger_score:6", "keys evs", "SELECT k.asset, k.rd, coalesce(disclosure_event_total_score, 0) AS disclosure_event_total_score, 0.0 AS event_merger_score FROM keys k LEFT JOIN evs e ON e.asset = k.asset AND e.rd = k.rd")
def _(s):
    from panelspark.functions.feature_groups import GROUPS, with_feature_group
    from panelspark.operators.hygiene import hard_sanitize

    sc = E.event_scores(s.disclosures(), event_universe(s)).select("asset", "rd", *GROUPS["events"])
    return hard_sanitize(with_feature_group(s.keys().join(sc, ["asset", "rd"], "left"), "events"), GROUPS["events"])


_S = lambda e, w: f"coalesce(sum({e}) FILTER ({w}), 0)::DOUBLE"
_N = lambda w: f"count(*) FILTER ({w})"
_M12, _M18, _M24 = ("rcept_dt > CAST(m.snapshot_date - INTERVAL %d MONTH AS DATE)" % k for k in (12, 18, 24))
add_cte("gin", "mcap assets disc", f"""
    SELECT m.asset, m.snapshot_date AS rd, any_value(m.market_cap) AS mc, any_value(a.group_flag) AS gf, {_S('nstk_ostk_qy::DECIMAL(12,0) * bdis_pric', _M12)} AS dil, {_S('bd_fta', _M12)} AS bond, {_S('dppln_prc_ostk', _M12)} AS sale, {_S('aqpln_prc_ostk', _M12)} AS buy,
      {_N(_M12 + " AND ic_mthn LIKE '%3자배정%'")} AS tp, {_N(_M12 + " AND event_category = 'bonus_issue'")} AS bonus, {_N(_M18 + " AND event_category = 'spinoff'")} AS spin, {_N(_M18 + " AND div_mth LIKE '%물적%'")} AS phys,
      {_N(_M18 + " AND event_category = 'capital_reduction'")} AS cr, {_N(_M24 + " AND event_category = 'insider_holdings'")} AS ins, {_N(_M24 + " AND event_category = 'major_holders'")} AS maj
    FROM mcap m JOIN assets a ON a.asset = m.asset LEFT JOIN disc d ON d.asset = m.asset AND d.rcept_dt <= m.snapshot_date GROUP BY 1, 2""")
add_cte("gsc", "gin", """
    SELECT *, least(1, 0.5 * least(1, dil / mc / 0.1) + 0.3 * least(1, bond / mc / 0.2) + 0.2 * CASE WHEN tp > 0 THEN 1 ELSE 0 END) AS g1, least(1, sale / mc / 0.05) AS g2, CASE WHEN phys > 0 THEN 0.7 WHEN spin > 0 THEN 0.3 ELSE 0 END AS g3, CASE WHEN cr > 0 THEN 1 ELSE 0 END AS g4,
      CASE WHEN gf THEN least(1, (0.4 * least(1, ins / 30.0) + 0.2 * least(1, maj / 10.0)) * 1.5) ELSE 0.4 * least(1, ins / 30.0) + 0.2 * least(1, maj / 10.0) END AS g5, least(1, 0.6 * least(1, buy / mc / 0.02) + 0.3 * CASE WHEN bonus > 0 THEN 1 ELSE 0 END) AS g6 FROM gin""")
add_cte("gov", "gsc", """
    SELECT asset, rd, g1 AS owner_dilution_risk_score, g2 AS treasury_sale_overhang_score, g3 AS spinoff_listing_risk_score, g4 AS capital_reduction_active_flag, g5 AS succession_risk_score, g6 AS capital_allocation_quality_score, risk AS governance_risk_score, g6 AS governance_quality_score,
      greatest(0, risk - g6) AS minority_shareholder_discount_score, CASE WHEN (dil / mc >= 0.1 AND tp > 0) OR dil / mc >= 0.2 OR sale / mc >= 0.05 OR cr > 0 OR phys > 0 THEN 1.0 ELSE 0 END AS governance_hard_veto_flag,
      CASE WHEN risk >= 0.4 OR greatest(g1, g2, g3) >= 0.6 THEN 1.0 ELSE 0 END AS governance_watchlist_flag FROM (SELECT *, least(1, 0.3 * g1 + 0.2 * g2 + 0.2 * g3 + 0.15 * g5 + 0.15 * g4) AS risk FROM gsc)""")
_G = lambda s: E.governance_scores(s.disclosures(), event_universe(s))
for _name, _out in [("owner_dilution_risk", "owner_dilution_risk_score:6"), ("treasury_overhang", "treasury_sale_overhang_score:6"), ("spinoff_risk", "spinoff_listing_risk_score:6"), ("capital_reduction_flag", "capital_reduction_active_flag:1"),
                    ("succession_proxy", "succession_risk_score:6"), ("capital_allocation_quality", "capital_allocation_quality_score:6"),
                    ("governance_scores", "governance_risk_score:6 governance_quality_score:6 owner_dilution_risk_score:6 treasury_sale_overhang_score:6 succession_risk_score:6 minority_shareholder_discount_score:6 spinoff_listing_risk_score:6 governance_watchlist_flag:1 governance_hard_veto_flag:1")]:
    query(_name, f"asset rd:d {_out}", "gov", "SELECT * FROM gov")(_G)
query("hard_veto_filter", "asset rd:d governance_risk_score:6", "gov", "SELECT * FROM gov WHERE governance_hard_veto_flag < 0.5")(lambda s: E.hard_veto_filter(_G(s)))


@query("add_governance", "asset rd:d governance_risk_score:6 governance_hard_veto_flag:1 related_party_leakage_score:1", "keys gov", "SELECT k.asset, k.rd, coalesce(governance_risk_score, 0) AS governance_risk_score, coalesce(governance_hard_veto_flag, 0) AS governance_hard_veto_flag, 0.0 AS related_party_leakage_score FROM keys k LEFT JOIN gov g ON g.asset = k.asset AND g.rd = k.rd")
def _(s):
    from panelspark.functions.feature_groups import GROUPS
    from panelspark.operators.hygiene import hard_sanitize

    g = _G(s).select("asset", "rd", *GROUPS["governance"])
    return hard_sanitize(s.keys().join(g, ["asset", "rd"], "left"), GROUPS["governance"])
