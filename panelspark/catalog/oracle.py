"""DuckDB text of the derived panel tables: the independent side of every check."""

from __future__ import annotations

EXCH = "CASE WHEN {k} % 2 = 0 THEN 'KOSPI' ELSE 'KOSDAQ' END"
AID = "lpad(CAST({k} AS VARCHAR), greatest(6, length(CAST({k} AS VARCHAR)))::INT, '0')"
C = "CAST(round({c} * 100) AS BIGINT)"


def _aid(k: str) -> str:
    return AID.format(k=k)


ISSUER = _aid("o_custkey % ((SELECT max(s_suppkey) FROM supplier) + 1)")

CTES: dict[str, tuple[list[str], str]] = {
    "daily": ([], f"""
        SELECT l_suppkey, CAST(l_shipdate AS DATE) AS d,
               CAST(sum(p4 * q) AS BIGINT) AS pv, CAST(sum(q) AS BIGINT) AS qty,
               max(p4 * (200 + tax)) AS hi, min(p4 * (200 - tax)) AS lo
        FROM (SELECT l_suppkey, l_shipdate, CAST(l_quantity AS BIGINT) AS q, {C.format(c='l_tax')} AS tax,
                     {C.format(c='p_retailprice')} * (100 - {C.format(c='l_discount')}) AS p4
              FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1, 2"""),
    "bars": (["daily"], f"""
        SELECT {_aid('l_suppkey')} AS asset, d, CAST((hi + 19999) // 20000 AS DOUBLE) AS high,
               CAST(lo // 20000 AS DOUBLE) AS low, CAST((2 * pv + 100 * qty) // (200 * qty) AS DOUBLE) AS close,
               CAST(qty AS DOUBLE) AS volume, CAST(pv // 100 AS DOUBLE) AS value,
               row_number() OVER (PARTITION BY l_suppkey ORDER BY d) - 1 AS t FROM daily"""),
    "idx": (["daily"], f"""
        SELECT index_id, d, CAST((2 * sum(pv) + 100 * sum(qty)) // (200 * sum(qty)) AS DOUBLE) AS close, CAST(sum(qty) AS DOUBLE) AS volume FROM (
          SELECT 'ALL' AS index_id, d, pv, qty FROM daily UNION ALL
          SELECT {EXCH.format(k='l_suppkey')}, d, pv, qty FROM daily) GROUP BY 1, 2"""),
    "mkt": (["idx"], "SELECT d, close, volume, row_number() OVER (ORDER BY d) - 1 AS t FROM idx WHERE index_id = 'ALL'"),
    "assets": ([], f"""
        SELECT {_aid('s_suppkey')} AS asset,
               s_name || CASE WHEN s_suppkey % 23 = 3 THEN ' SPAC' WHEN s_suppkey % 29 = 4 THEN ' REIT' ELSE '' END AS name,
               {EXCH.format(k='s_suppkey')} AS exchange, 'S' || CAST(s_nationkey % 5 AS VARCHAR) AS sector,
               s_suppkey % 5 = 0 AS group_flag, s_nationkey AS industry, (s_nationkey + 1) * 2500000::BIGINT AS listed_shares
        FROM supplier"""),
    "cal": ([], "SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem"),
    "rds": (["cal"], "SELECT max(d) AS rd FROM cal GROUP BY date_trunc('month', d)"),
    "keys": (["bars", "rds"], """
        SELECT asset, rd FROM (SELECT asset, min(d) AS a, max(d) AS b FROM bars GROUP BY 1)
        JOIN rds ON date_trunc('month', rd) BETWEEN date_trunc('month', a) AND date_trunc('month', b)"""),
    "mclose": (["keys", "bars"], "SELECT k.asset, k.rd, b.close FROM keys k ASOF LEFT JOIN bars b ON k.asset = b.asset AND k.rd >= b.d"),
    "mcap": (["mclose", "assets"], """
        SELECT asset, rd AS snapshot_date, exchange AS market, close * listed_shares AS market_cap, listed_shares
        FROM mclose JOIN assets USING (asset)"""),
    "listed": (["mcap", "bars"], """
        SELECT m.* FROM mcap m JOIN (SELECT asset, date_trunc('month', d) AS mm FROM bars GROUP BY 1, 2 HAVING count(*) >= 6) a
        ON a.asset = m.asset AND a.mm = date_trunc('month', m.snapshot_date)"""),
    "presence": ([], f"""
        SELECT DISTINCT {_aid('l_partkey')} AS asset, last_day(CAST(l_shipdate AS DATE)) AS snapshot_date,
               {EXCH.format(k='l_partkey')} AS market FROM lineitem"""),
    "flow": ([], f"""
        SELECT {_aid('l_suppkey')} AS asset, d, f AS foreign_net, i AS inst_net, -(f + i) AS individual_net,
               50.0::DOUBLE + 50.0::DOUBLE * CAST(sum(fq) OVER w AS DOUBLE) / CAST(sum(q) OVER w AS DOUBLE) AS holding_pct,
               row_number() OVER w - 1 AS t
        FROM (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS d,
                CAST(sum(CASE WHEN l_returnflag = 'A' THEN s * amt ELSE 0 END) AS DOUBLE) AS f,
                CAST(sum(CASE WHEN l_returnflag = 'R' THEN s * amt ELSE 0 END) AS DOUBLE) AS i,
                sum(CASE WHEN l_returnflag = 'A' THEN s * CAST(l_quantity AS BIGINT) ELSE 0 END) AS fq,
                sum(CAST(l_quantity AS BIGINT)) AS q
              FROM (SELECT *, CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS s, {C.format(c='l_extendedprice')} AS amt
                    FROM lineitem WHERE l_linestatus IN ('O', 'F')) GROUP BY 1, 2)
        WINDOW w AS (PARTITION BY l_suppkey ORDER BY d)"""),
    "invflow": ([], f"""
        SELECT {EXCH.format(k='l_suppkey')} AS market, CAST(l_shipdate AS DATE) AS d,
               ['individual','foreign','inst','pension','inv_trust','private_equity','bank'][l_linenumber] AS investor,
               CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END * {C.format(c='l_extendedprice')}) AS DOUBLE) AS net
        FROM lineitem GROUP BY 1, 2, 3"""),
    "mflow": (["invflow"], """
        SELECT market, d, coalesce(max(net) FILTER (investor = 'foreign'), 0) AS foreign_net,
               coalesce(max(net) FILTER (investor = 'inst'), 0) AS inst_net FROM invflow GROUP BY 1, 2"""),
    "fund": ([], f"""
        SELECT asset, year, ['11013','11012','11014','11011'][qtr] AS reprt_code, pe AS period_end,
               pe + CAST(45 + CAST(asset AS INT) % 30 AS INT) AS rcept_dt,
               sum(rev) OVER y / 100 AS revenue, sum(op) OVER y / 100 AS operating_income, sum(ni) OVER y / 100 AS net_income,
               sum(rev) OVER l / 100 AS total_assets, sum(rev - li) OVER l / 100 AS total_equity, sum(li) OVER l / 100 AS total_liabilities
        FROM (SELECT asset, year, qtr, last_day(make_date(CAST(year AS INT), CAST(qtr * 3 AS INT), 1)) AS pe,
                CAST(sum(c) AS DOUBLE) AS rev, CAST(sum(CASE WHEN st = 'F' THEN -c ELSE c END) AS DOUBLE) AS op,
                CAST(sum(CASE st WHEN 'O' THEN c WHEN 'F' THEN -c ELSE 0 END) AS DOUBLE) AS ni,
                CAST(sum(CASE WHEN st = 'F' THEN c ELSE 0 END) AS DOUBLE) AS li
              FROM (SELECT {ISSUER} AS asset, year(o_orderdate) AS year, quarter(o_orderdate) AS qtr,
                           o_orderstatus AS st, {C.format(c='o_totalprice')} AS c FROM orders) GROUP BY 1, 2, 3)
        WINDOW y AS (PARTITION BY asset, year ORDER BY qtr), l AS (PARTITION BY asset ORDER BY year, qtr)"""),
    "funda": (["fund"], f"""
        SELECT * FROM fund UNION ALL
        SELECT asset, year, reprt_code, period_end, rcept_dt + CAST(20 + CAST(asset AS INT) % 10 * 50 AS INT), (round(revenue * 100) - py) / 100, (round(operating_income * 100) - py) / 100, net_income,
               (round(total_assets * 100) - pl) / 100, (round(total_equity * 100) - pl) / 100, total_liabilities
        FROM fund JOIN (
          SELECT asset AS pa, year AS y, qtr, sum(p) OVER (PARTITION BY asset, year ORDER BY qtr) AS py, sum(p) OVER (PARTITION BY asset ORDER BY year, qtr) AS pl
          FROM (SELECT {ISSUER} AS asset, year(o_orderdate) AS year, quarter(o_orderdate) AS qtr,
                  CAST(sum(CASE WHEN o_orderstatus = 'P' THEN {C.format(c='o_totalprice')} ELSE 0 END) AS DOUBLE) AS p FROM orders GROUP BY 1, 2, 3))
        ON pa = asset AND y = year AND reprt_code = ['11013','11012','11014','11011'][qtr]
        WHERE (CAST(asset AS INT) + year * 4 + qtr) % 3 = 0"""),
    "disc": ([], f"""
        SELECT asset, rcept_no, rcept_dt, cat AS event_category,
               CASE WHEN cat = 'treasury_buyback' THEN cents * 100 END AS aqpln_prc_ostk,
               CASE WHEN cat = 'treasury_sell' THEN cents * 100 END AS dppln_prc_ostk,
               CASE WHEN cat IN ('convertible_bond', 'warrant_bond') THEN cents * 1000 END AS bd_fta,
               CASE WHEN cat = 'capital_increase' THEN 100000 END AS nstk_ostk_qy,
               CASE WHEN cat = 'capital_increase' THEN cents::DECIMAL(12,0) * 0.01::DECIMAL(3,2) END AS bdis_pric,
               CASE WHEN cat = 'capital_increase' THEN CASE WHEN pri = '1-URGENT' THEN '제3자배정증자' ELSE '주주배정증자' END END AS ic_mthn,
               CASE WHEN cat = 'spinoff' THEN CASE WHEN st = 'F' THEN '물적분할' ELSE '인적분할' END END AS div_mth,
               CASE WHEN cat = 'insider_holdings' THEN ck END AS bsis_stkqy,
               CASE WHEN cat = 'insider_holdings' THEN ck + CASE st WHEN 'O' THEN 5000 WHEN 'F' THEN -5000 ELSE 0 END END AS aft_stkqy,
               CASE WHEN cat = 'insider_holdings' THEN cents::DECIMAL(12,0) * 0.1::DECIMAL(2,1) END AS trade_uv,
               CASE WHEN cat = 'major_holders' THEN (ck % 201 - 100)::DECIMAL(6,0) * 0.01::DECIMAL(3,2) END AS stkrt_irds
        FROM (SELECT {ISSUER} AS asset, CAST(o_orderdate AS DATE) AS rcept_dt,
                strftime(o_orderdate, '%Y%m%d') || lpad(CAST(o_orderkey AS VARCHAR), greatest(6, length(CAST(o_orderkey AS VARCHAR)))::INT, '0') AS rcept_no,
                ['treasury_buyback','capital_increase','bonus_issue','treasury_sell','convertible_bond','warrant_bond',
                 'insider_holdings','major_holders','merger','spinoff','capital_reduction'][o_orderkey % 11 + 1] AS cat,
                {C.format(c='o_totalprice')} AS cents, o_orderpriority AS pri, o_orderstatus AS st, o_custkey AS ck FROM orders)"""),
    "macro": ([], f"""
        SELECT m[1] AS series, obs_date, c / CAST(n * 100 AS DOUBLE) / CAST(m[2] AS DOUBLE) AS value FROM (
          SELECT obs_date, CAST(sum(c) AS DOUBLE) AS c, count(*) AS n,
            [['bok_base_rate','100000'],['ktb_3y_yield','100000'],['ktb_10y_yield','80000'],['usd_krw','200'],['kr_pmi','5000'],
             ['consumer_sentiment','2500'],['business_sentiment','3000'],['kr_industrial_prod','2500'],['kr_export_yoy','20000'],
             ['us_10y','60000'],['us_2y','70000'],['vix','12000'],['dxy','2500'],['wti_close','3500'],['cpi_yoy','90000']][k] AS m
          FROM (SELECT (CAST(o_orderpriority[1] AS INT) - 1) * 3 + CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END + 1 AS k,
                  CAST(o_orderdate AS DATE) AS obs_date, {C.format(c='o_totalprice')} AS c FROM orders) GROUP BY k, obs_date)"""),
    "themes": ([], f"""
        SELECT 'A' || CAST(s_suppkey % 6 AS VARCHAR) AS theme, {_aid('s_suppkey')} AS asset FROM supplier UNION ALL
        SELECT 'B' || CAST(s_suppkey % 10 AS VARCHAR), {_aid('s_suppkey')} FROM supplier UNION ALL
        SELECT 'C' || CAST(s_suppkey % 4 AS VARCHAR), {_aid('s_suppkey')} FROM supplier"""),
    "ticks": ([], f"""
        SELECT {_aid('user_id % ((SELECT max(s_suppkey) FROM supplier) + 1)')} AS asset, ts, value AS price, event_type, event_id FROM events"""),
}


def with_ctes(names: list[str], body: str, extra: dict[str, tuple[list[str], str]] | None = None) -> str:
    """Prefix `body` with the named derived tables and whatever they depend on."""
    table = {**CTES, **(extra or {})}
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in table[n][0]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({table[n][1]})" for n in order) + "\n" + body
