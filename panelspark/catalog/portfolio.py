"""Portfolio construction and evaluation."""

from pyspark.sql import functions as F

from panelspark.catalog.fundamental_events import E, event_universe
from panelspark.catalog.registry import add_cte, query
from panelspark.operators import portfolio as P, universe as U, xsection as XS
from panelspark.sources.calendars import holding_periods

METHODS = ["equal", "score", "score_power", "capped", "concentrated"]


def selection(s):
    """The 15 dearest names per date under five weighting methods, one strategy each."""
    top = XS.rank_in_date(s.mcap().select("asset", F.col("snapshot_date").alias("rd"), "market_cap", (F.col("market_cap") / F.col("listed_shares")).alias("price")), "price", 15)
    top = top.withColumn("score", F.round(F.col("price") - 80000, 0)).withColumn("strategy", F.explode(F.array(*[F.lit(m) for m in METHODS])))
    return P.weights(top, F.col("strategy"))


def periods(s):
    return holding_periods(s.month_ends())


add_cte("top15", "mcap", """
    SELECT *, greatest(price - 80000, 0) AS sc FROM (SELECT asset, snapshot_date AS rd, market_cap, market_cap / listed_shares AS price, row_number() OVER (PARTITION BY snapshot_date ORDER BY market_cap / listed_shares DESC, asset) AS rank FROM mcap) WHERE rank <= 15""")
add_cte("sel", "top15", """
    SELECT *, w / sum(w) OVER (PARTITION BY strategy, rd) AS weight FROM (SELECT * EXCLUDE (w), CASE WHEN strategy IN ('capped', 'concentrated') THEN least(w, 0.14) ELSE w END AS w FROM (
      SELECT *, CASE WHEN sum(raw) OVER (PARTITION BY strategy, rd) > 0 THEN raw / sum(raw) OVER (PARTITION BY strategy, rd) ELSE 1.0::DOUBLE / count(*) OVER (PARTITION BY strategy, rd) END AS w FROM (
        SELECT *, CASE strategy WHEN 'equal' THEN 1 WHEN 'score_power' THEN sc * sc WHEN 'concentrated' THEN pow(rank, -2) ELSE sc END::DOUBLE AS raw FROM top15, (VALUES ('equal'), ('score'), ('score_power'), ('capped'), ('concentrated')) v(strategy))))""")
add_cte("per", "rds", "SELECT rd, lead(rd) OVER (ORDER BY rd) AS rd_next FROM rds")
query("weights", "strategy rd:d asset weight:8", "sel", "SELECT * FROM sel")(selection)


@query("water_fill_cap", "strategy rd:d asset capped_weight:7", "sel", """
    SELECT strategy, rd, asset, CASE WHEN r <= k THEN 0.1 ELSE weight * (1 - k * 0.1::DOUBLE) / rest END AS capped_weight FROM (
      SELECT *, sum(weight) FILTER (r > k) OVER (PARTITION BY strategy, rd) AS rest FROM (
        SELECT s.*, (SELECT min(j) FROM (SELECT j, (SELECT max(weight) FROM sel y WHERE y.strategy = s.strategy AND y.rd = s.rd) FROM range(0, 16) g(j)) q WHERE
             coalesce((SELECT max(z.weight) FROM (SELECT weight, row_number() OVER (ORDER BY weight DESC, asset) AS rr FROM sel x WHERE x.strategy = s.strategy AND x.rd = s.rd) z WHERE z.rr > j), 0) * (1 - j * 0.1::DOUBLE)
             <= (0.1::DOUBLE + 1e-12) * coalesce((SELECT sum(z.weight) FROM (SELECT weight, row_number() OVER (ORDER BY weight DESC, asset) AS rr FROM sel x WHERE x.strategy = s.strategy AND x.rd = s.rd) z WHERE z.rr > j), 0)) AS k,
          row_number() OVER (PARTITION BY strategy, rd ORDER BY weight DESC, asset) AS r FROM sel s))""")
def _(s):
    return P.water_fill_cap(selection(s), "weight", 0.1)


query("cost_bp", "asset snapshot_date:d side:2 rt:2", "mcap", "SELECT asset, snapshot_date, c AS side, 2 * c + 18 AS rt FROM (SELECT *, 1.5 + CASE WHEN market_cap >= 5e12 THEN 5 WHEN market_cap >= 1e12 THEN 10 ELSE 20 END AS c FROM mcap)")(
    lambda s: s.mcap().select("asset", "snapshot_date", P.cost_bp_per_side(F.col("market_cap")).alias("side"), P.round_trip_bp(F.col("market_cap")).alias("rt")))

add_cte("pos", "sel atv", """
    SELECT s.*, least(1e7 * weight, v * 0.05) AS notional, 1e7 * weight > v * 0.05 AS liquidity_capped, floor(least(1e7 * weight, v * 0.05) / price) AS shares
    FROM sel s JOIN (SELECT asset, rd, coalesce(avg_trading_value_60d, 0) AS v FROM atv) a USING (asset, rd)""")


def positions(s):
    liq = U.avg_trading_value(s.bars(), s.keys())
    return P.target_positions(selection(s).join(liq, ["asset", "rd"]).withColumn("capital", F.lit(1e7)))


query("target_positions", "strategy rd:d asset notional:4 shares:0 realised_weight:7 liquidity_capped", "pos", "SELECT *, shares * price / 1e7 AS realised_weight FROM pos")(positions)
query("trade_list", "strategy rd:d asset side shares:0 notional:2 cost:6", "pos per", """
    SELECT strategy, rd, asset, CASE WHEN delta > 0 THEN 'BUY' ELSE 'SELL' END AS side, abs(delta) AS shares, abs(delta) * price AS notional, abs(delta) * price * (c + CASE WHEN delta < 0 THEN 18 ELSE 0 END) / 1e4 AS cost FROM (
      SELECT strategy, rd, asset, coalesce(n.shares, 0) - coalesce(o.shares, 0) AS delta, coalesce(n.price, o.price) AS price, 1.5 + CASE WHEN coalesce(n.market_cap, o.market_cap) >= 5e12 THEN 5 WHEN coalesce(n.market_cap, o.market_cap) >= 1e12 THEN 10 ELSE 20 END AS c
      FROM pos n FULL JOIN (SELECT strategy, asset, p.rd_next AS rd, shares, price, market_cap FROM pos JOIN per p ON p.rd = pos.rd WHERE p.rd_next IS NOT NULL) o USING (strategy, rd, asset)) WHERE delta <> 0""")(
    lambda s: P.trade_list(positions(s), periods(s)))
add_cte("hold", "sel per bars", """
    SELECT h.*, CASE WHEN a.close > 0 AND b.close IS NOT NULL THEN b.close / a.close - 1 ELSE 0 END AS period_return FROM (SELECT s.*, p.rd_next FROM sel s JOIN per p USING (rd) WHERE p.rd_next IS NOT NULL) h
    ASOF LEFT JOIN bars a ON a.asset = h.asset AND h.rd >= a.d ASOF LEFT JOIN bars b ON b.asset = h.asset AND h.rd_next >= b.d""")
query("period_returns", "strategy rd:d rd_next:d asset period_return:8", "hold", "SELECT * FROM hold")(lambda s: P.period_returns(selection(s), s.bars(), periods(s)))
add_cte("turn", "sel per", """
    SELECT strategy, rd, sum(abs(coalesce(n.weight, 0) - coalesce(o.weight, 0))) / 2 AS turnover, sum(CASE WHEN n.weight IS NULL OR o.weight IS NULL THEN 1 ELSE 0 END) AS sd, count(n.weight) AS n, count(o.weight) AS old
    FROM sel n FULL JOIN (SELECT strategy, asset, weight, p.rd_next AS rd FROM sel JOIN per p ON p.rd = sel.rd WHERE p.rd_next IS NOT NULL) o USING (strategy, rd, asset) GROUP BY 1, 2""")
query("weight_turnover", "strategy rd:d turnover:8", "turn", "SELECT * FROM turn")(lambda s: P.weight_turnover(selection(s), periods(s)))
query("name_turnover", "strategy rd:d name_turnover:8", "turn", "SELECT strategy, rd, CASE WHEN old = 0 THEN 1 ELSE sd / (2.0::DOUBLE * n) END AS name_turnover FROM turn")(lambda s: P.name_turnover(selection(s), periods(s)))
add_cte("bt", "hold turn", """
    SELECT *, gross_return - cost AS net_return FROM (SELECT h.strategy, h.rd, h.rd_next, sum(weight * period_return) AS gross_return, count(*) AS n_holdings, any_value(turnover) AS turnover, any_value(turnover) * 0.0031::DOUBLE AS cost
    FROM hold h JOIN turn t ON t.strategy = h.strategy AND t.rd = h.rd GROUP BY 1, 2, 3)""")
query("topn_backtest", "strategy rd:d rd_next:d gross_return:8 n_holdings:i turnover:8 cost:9 net_return:8", "bt", "SELECT * FROM bt")(lambda s: P.backtest_periods(selection(s), s.bars(), periods(s)))
add_cte("eq", "bt", "SELECT *, exp(sum(ln(1 + net_return)) OVER (PARTITION BY strategy ORDER BY rd)) AS cum FROM bt")
add_cte("met", "eq", """
    SELECT strategy, count(*) AS rebalance_count, exp(sum(ln(1 + net_return))) AS final_cum_return, pow(exp(sum(ln(1 + net_return))), 12.0::DOUBLE / count(*)) - 1 AS strategy_cagr, avg(net_return) / stddev_samp(net_return) * sqrt(12) AS sharpe,
      least(min(cum / mx - 1), 0) AS max_dd, avg(turnover) AS avg_turnover, sum(cost) AS total_cost_drag, avg(CASE WHEN net_return > 0 THEN 1.0::DOUBLE ELSE 0 END) AS beat_month_ratio, avg(n_holdings) AS n_holdings_avg, min(rd) AS s0, max(rd_next) AS s1
    FROM (SELECT *, max(cum) OVER (PARTITION BY strategy ORDER BY rd) AS mx FROM eq) GROUP BY 1""")


def metrics(s):
    return P.portfolio_metrics(P.backtest_periods(selection(s), s.bars(), periods(s)))


query("portfolio_metrics", "strategy rebalance_count:i final_cum_return:7 strategy_cagr:7 sharpe:6 max_dd:7 avg_turnover:7 total_cost_drag:7 beat_month_ratio:7 n_holdings_avg:4", "met", "SELECT * FROM met")(metrics)
query("running_drawdown", "strategy rd:d drawdown:7", "eq", "SELECT strategy, rd, cum / max(cum) OVER (PARTITION BY strategy ORDER BY rd) - 1 AS drawdown FROM eq")(
    lambda s: P.running_drawdown(P.equity_curve(P.backtest_periods(selection(s), s.bars(), periods(s))), F.col("cum_return"), ["strategy"]))
add_cte("exc", "met mkt", "SELECT m.*, pow(b.close / a.close, 12.0::DOUBLE / rebalance_count) - 1 AS benchmark_cagr FROM met m ASOF LEFT JOIN mkt a ON m.s0 >= a.d ASOF LEFT JOIN mkt b ON m.s1 >= b.d")
query("benchmark_excess", "strategy strategy_cagr:7 benchmark_cagr:7 excess_cagr:7 verdict", "exc", """
    SELECT *, strategy_cagr - benchmark_cagr AS excess_cagr, CASE WHEN strategy_cagr - benchmark_cagr >= 0.03 THEN 'SHIP' WHEN strategy_cagr - benchmark_cagr >= 0 THEN 'PARTIAL' ELSE 'REGRESS' END AS verdict FROM exc""")(
    lambda s: P.with_benchmark(metrics(s), s.market()).withColumn("verdict", P.verdict(F.col("excess_cagr"))))
query("exposure_scale", "strategy rd:d sleeve_scale:2 cash_floor:2 dd_level:i vkospi_cash_floor:2", "eq deriv", """
    SELECT *, 1 - sleeve_scale AS cash_floor FROM (SELECT *, least(CASE dd_level WHEN 3 THEN 0.4 WHEN 2 THEN 0.65 WHEN 1 THEN 0.85 ELSE 1 END, 1 - vkospi_cash_floor) AS sleeve_scale FROM (
      SELECT strategy, rd, CASE WHEN dd <= -0.25 THEN 3 WHEN dd <= -0.15 THEN 2 WHEN dd <= -0.08 THEN 1 ELSE 0 END AS dd_level, CASE WHEN vk * 20 > 35 THEN 0.5 WHEN vk * 20 > 25 THEN 0.3 ELSE 0 END AS vkospi_cash_floor FROM (
        SELECT e.strategy, e.rd, cum / max(cum) OVER (PARTITION BY strategy ORDER BY rd) - 1 AS dd, v.vk FROM eq e ASOF LEFT JOIN (SELECT d, vkospi_level AS vk FROM deriv) v ON e.rd >= v.d)))""")(
    lambda s: _exposure(s))


def _exposure(s):
    from panelspark.catalog.flow_macro import M, derivatives

    eq = P.running_drawdown(P.equity_curve(P.backtest_periods(selection(s), s.bars(), periods(s))), F.col("cum_return"), ["strategy"])
    vol = M.asof_panel(derivatives(s), s.month_ends(), ["vkospi_level"])
    return eq.join(vol, "rd", "left").withColumns(P.exposure_scale(F.col("drawdown"), F.col("vkospi_level") * 20))


query("membership_change", "rd:d change:8", "listed per", """
    SELECT p.rd_next AS rd, 1 - count(*) FILTER (a.asset IS NOT NULL AND b.asset IS NOT NULL) / count(*)::DOUBLE AS change FROM per p JOIN
      (SELECT coalesce(x.asset, y.asset) AS asset, coalesce(x.rd, y.rd) AS rd FROM (SELECT asset, snapshot_date AS rd FROM listed) x FULL JOIN (SELECT l.asset, q.rd FROM listed l JOIN per q ON q.rd_next = l.snapshot_date) y ON x.asset = y.asset AND x.rd = y.rd) u ON u.rd = p.rd
      LEFT JOIN listed a ON a.asset = u.asset AND a.snapshot_date = p.rd LEFT JOIN listed b ON b.asset = u.asset AND b.snapshot_date = p.rd_next WHERE p.rd_next IS NOT NULL GROUP BY 1""")(
    lambda s: P.membership_change(s.listed().withColumnRenamed("snapshot_date", "rd"), periods(s)))
query("validation_suite", "members_min:i members_max:i members_mean:6 max_null_rate:8 change_max:8 members_pass nulls_pass all_pass", "keys ret", """
    SELECT *, members_min >= 200 AS members_pass, max_null_rate < 0.3 AS nulls_pass, members_min >= 200 AND max_null_rate < 0.3 AND change_max < 0.5 AS all_pass FROM (
      SELECT min(n) AS members_min, max(n) AS members_max, avg(n) AS members_mean FROM (SELECT count(*) AS n FROM keys GROUP BY rd)),
      (SELECT greatest(avg(CASE WHEN ret_12m IS NULL THEN 1.0::DOUBLE ELSE 0 END), avg(CASE WHEN ret_3m IS NULL THEN 1.0::DOUBLE ELSE 0 END)) AS max_null_rate FROM ret),
      (SELECT max(1 - n12::DOUBLE / (n1 + n2 - n12)) AS change_max FROM (SELECT p.rd, (SELECT count(*) FROM keys k WHERE k.rd = p.rd) AS n1, (SELECT count(*) FROM keys k WHERE k.rd = p.rd_next) AS n2,
         (SELECT count(*) FROM keys a JOIN keys b ON a.asset = b.asset AND a.rd = p.rd AND b.rd = p.rd_next) AS n12 FROM (SELECT rd, lead(rd) OVER (ORDER BY rd) AS rd_next FROM (SELECT DISTINCT rd FROM keys)) p WHERE rd_next IS NOT NULL))""")(
    lambda s: P.validation_suite(XS.calendar_returns(s.bars(), s.keys()), ["ret_12m", "ret_3m"], periods(s)))
query("governance_weight_cap", "asset rd:d capped:8", "gov", "SELECT asset, rd, CASE WHEN governance_risk_score >= 0.8 THEN 0 WHEN governance_risk_score >= 0.6 THEN 0.02 WHEN governance_risk_score >= 0.4 THEN 0.04 ELSE 0.1 END AS capped FROM gov")(
    lambda s: E.governance_scores(s.disclosures(), event_universe(s)).select("asset", "rd", E.governance_weight_cap(F.col("governance_risk_score"), F.lit(0.1)).alias("capped")))
query("governance_adjusted_score", "asset rd:d adj:8", "gov mclose", "SELECT g.asset, g.rd, close / 99991 * (1 - 0.35 * governance_risk_score) AS adj FROM gov g JOIN mclose c ON c.asset = g.asset AND c.rd = g.rd")(
    lambda s: E.governance_scores(s.disclosures(), event_universe(s)).join(s.month_closes(), ["asset", "rd"]).select("asset", "rd", (F.col("close") / 99991 * (1 - 0.35 * F.col("governance_risk_score"))).alias("adj")))


def picks(s):
    """Two probability-like scores per (asset, rd) with governance and volatility attached."""
    from panelspark.catalog.flow_macro import M, derivatives

    g = E.governance_scores(s.disclosures(), event_universe(s)).select("asset", "rd", "governance_risk_score", "governance_hard_veto_flag", "market_cap")
    c = s.month_closes().withColumns({"p_pre_entry": F.col("close") / 1e5, "p_continuation": F.pmod(F.col("close") * 7, F.lit(1000.0)) / 1000})
    vol = M.asof_panel(derivatives(s), s.month_ends(), ["vkospi_level"]).withColumn("vkospi_level", F.col("vkospi_level") * 20)
    return c.join(g, ["asset", "rd"]).join(vol, "rd", "left").drop("close")


add_cte("picks", "mclose gov deriv mcap", """
    SELECT c.asset, c.rd, close / 1e5 AS p_pre_entry, (close * 7) % 1000 / 1000 AS p_continuation, g.governance_risk_score AS risk, g.governance_hard_veto_flag AS veto, m.market_cap, v.vk FROM mclose c JOIN gov g ON g.asset = c.asset AND g.rd = c.rd
    JOIN mcap m ON m.asset = c.asset AND m.snapshot_date = c.rd JOIN (SELECT rd, vkospi_level * 20 AS vk FROM (SELECT DISTINCT rd FROM mclose) r ASOF LEFT JOIN deriv ON r.rd >= deriv.d) v ON v.rd = c.rd""")
query("two_sleeve_select", "asset rd:d sleeve sleeve_rank:i", "picks", """
    WITH a AS (SELECT asset, rd, row_number() OVER (PARTITION BY rd ORDER BY p_pre_entry DESC, asset) AS r FROM picks QUALIFY r <= 6)
    SELECT asset, rd, 'pre_entry' AS sleeve, r AS sleeve_rank FROM a UNION ALL SELECT asset, rd, 'continuation', row_number() OVER (PARTITION BY rd ORDER BY p_continuation DESC, asset) AS r FROM picks p WHERE (asset, rd) NOT IN (SELECT asset, rd FROM a) QUALIFY r <= 4""")(
    lambda s: P.two_sleeve_select(picks(s), 10, 0.6, 0.4))
_V = "(VALUES " + ", ".join(f"('{k}', {v.guard}, {v.overlay}, {v.penalty}, {v.sleeves})" for k, v in P.VARIANTS.items()) + ") v(strategy, guard, overlay, penalty, sleeves)"
add_cte("vsel", "picks", f"""
    WITH d AS (SELECT *, p_pre_entry * f AS a, p_continuation * f AS b FROM (SELECT *, CASE WHEN overlay THEN 1 - penalty * risk ELSE 1 END::DOUBLE AS f FROM picks, {_V} WHERE NOT overlay OR veto < 0.5)),
      one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY strategy, rd ORDER BY a DESC, asset) AS r FROM d) WHERE r <= CASE WHEN sleeves THEN 5 ELSE 10 END),
      two AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY strategy, rd ORDER BY b DESC, asset) AS r FROM d WHERE sleeves AND (strategy, rd, asset) NOT IN (SELECT strategy, rd, asset FROM one)) WHERE r <= 5)
    SELECT strategy, rd, asset, CASE WHEN t > 0 THEN w / t ELSE w END * CASE WHEN guard THEN CASE WHEN vk > 35 THEN 0.5 WHEN vk > 25 THEN 0.7 ELSE 1 END ELSE 1 END AS weight FROM (SELECT *, sum(w) OVER (PARTITION BY strategy, rd) AS t FROM (
      SELECT *, CASE WHEN overlay THEN CASE WHEN risk >= 0.8 THEN 0 WHEN risk >= 0.6 THEN least(w0, 0.02) WHEN risk >= 0.4 THEN least(w0, 0.04) ELSE w0 END ELSE w0 END AS w FROM (
        SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY strategy, rd) AS w0 FROM (SELECT * FROM one UNION ALL SELECT * FROM two))))""")
add_cte("vret", "vsel per bars", """
    SELECT strategy, rd, sum(weight * r) AS gross FROM (SELECT h.*, CASE WHEN a.close > 0 AND b.close IS NOT NULL THEN b.close / a.close - 1 ELSE 0 END AS r FROM (SELECT v.*, p.rd_next FROM vsel v JOIN per p USING (rd) WHERE p.rd_next IS NOT NULL) h
      ASOF LEFT JOIN bars a ON a.asset = h.asset AND h.rd >= a.d ASOF LEFT JOIN bars b ON b.asset = h.asset AND h.rd_next >= b.d) GROUP BY 1, 2""")
query("variant_matrix", "strategy rebalance_count:i mean_gross:7 final_gross:7", "vret", "SELECT strategy, count(*) AS rebalance_count, avg(gross) AS mean_gross, exp(sum(ln(1 + gross))) AS final_gross FROM vret GROUP BY 1")(
    lambda s: P.backtest_periods(P.variant_selections(picks(s), 10), s.bars(), periods(s)).groupBy("strategy").agg(
        F.count(F.lit(1)).alias("rebalance_count"), F.avg("gross_return").alias("mean_gross"), F.exp(F.sum(F.log1p("gross_return"))).alias("final_gross")))
