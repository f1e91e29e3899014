"""Momentum, cross-sectional ranks and z-scores, row scores built on them."""

from pyspark.sql import functions as F

from panelspark.catalog.registry import add_cte, query
from panelspark.functions.scalars import weighted_blend
from panelspark.operators import xsection as XS

add_cte("momlong", "keys bars", """
    SELECT x.asset, x.rd, x.o, b.close FROM (SELECT asset, rd, o, CAST(rd - to_months(o) AS DATE) AS t FROM keys, (VALUES (0), (1), (3), (6), (12)) v(o)) x
    ASOF LEFT JOIN bars b ON x.asset = b.asset AND x.t >= b.d""")
add_cte("ret", "momlong", """
    SELECT asset, rd, c0 / c1 - 1 AS ret_1m, c0 / c3 - 1 AS ret_3m, c0 / c6 - 1 AS ret_6m, c0 / c12 - 1 AS ret_12m, c1 / c12 - 1 AS ret_12_1m FROM (
      SELECT asset, rd, """ + ", ".join(f"max(close) FILTER (o = {o}) AS c{o}" for o in (0, 1, 3, 6, 12)) + " FROM momlong GROUP BY 1, 2)")
add_cte("idxret", "rds idx", """
    SELECT rd, """ + ", ".join(f"max(CASE WHEN index_id = '{i}' THEN c0 / c{m} - 1 END) AS {i}_{m}" for i in ("KOSPI", "KOSDAQ") for m in (3, 12)) + """ FROM (
      SELECT index_id, rd, max(close) FILTER (o = 0) AS c0, max(close) FILTER (o = 3) AS c3, max(close) FILTER (o = 12) AS c12 FROM (
        SELECT x.index_id, x.rd, x.o, b.close FROM (SELECT index_id, rd, o, CAST(rd - to_months(o) AS DATE) AS t FROM rds, (VALUES (0), (3), (12)) v(o), (VALUES ('KOSPI'), ('KOSDAQ')) i(index_id)) x
        ASOF LEFT JOIN idx b ON x.index_id = b.index_id AND x.t >= b.d) GROUP BY 1, 2) GROUP BY 1""")
add_cte("mom0", "ret idxret", """
    SELECT r.*, ret_3m - KOSPI_3 AS rs_kospi_3m, ret_12m - KOSPI_12 AS rs_kospi_12m, ret_3m - KOSDAQ_3 AS rs_kosdaq_3m, ret_12m - KOSDAQ_12 AS rs_kosdaq_12m FROM ret r JOIN idxret USING (rd)""")
MOM = ["ret_1m", "ret_3m", "ret_6m", "ret_12m", "ret_12_1m", "rs_kospi_3m", "rs_kospi_12m", "rs_kosdaq_3m", "rs_kosdaq_12m"]
add_cte("mom", "mom0", "SELECT asset, rd, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in MOM) + " FROM mom0")


def z_sql(table: str, col: str, keys: str = "rd") -> str:
    """Winsorised median/MAD z-score of one column per date."""
    return f"""(SELECT asset, rd, CASE WHEN n >= 5 THEN CASE WHEN mad < 1e-12 THEN 0 WHEN x IS NULL THEN NULL ELSE greatest(-4, least(4, (w - m) / (1.4826::DOUBLE * mad))) END END AS z FROM (
      SELECT *, median(CASE WHEN x IS NOT NULL THEN abs(w - m) END) OVER (PARTITION BY {keys}) AS mad FROM (
        SELECT t.asset, t.rd, t.{col} AS x, q.n, q.m, CASE WHEN t.{col} IS NOT NULL THEN greatest(least(t.{col}, q.hi), q.lo) END AS w FROM {table} t JOIN
          (SELECT rd, count({col}) AS n, quantile_cont({col}, 0.01) AS lo, quantile_cont({col}, 0.5) AS m, quantile_cont({col}, 0.99) AS hi FROM {table} GROUP BY rd) q USING (rd))))"""


def rank_sql(col: str, keys: str = "rd") -> str:
    return f"CASE WHEN {col} IS NOT NULL THEN (rank() OVER (PARTITION BY {keys} ORDER BY {col} NULLS LAST) + (count(*) OVER (PARTITION BY {keys}, {col}) - 1) / 2.0::DOUBLE) / count({col}) OVER (PARTITION BY {keys}) END"


def momentum(s, fill=0.0):
    return XS.momentum_features(s.bars(), s.index_bars(), s.keys(), fill)


query("calendar_return", "asset rd:d " + " ".join(f"{c}:8" for c in MOM[:5]), "ret", "SELECT * FROM ret")(lambda s: XS.calendar_returns(s.bars(), s.keys()))
query("momentum_features", "asset rd:d " + " ".join(f"{c}:8" for c in MOM), "mom", "SELECT * FROM mom")(momentum)
_R = ["ret_3m", "ret_12_1m"]
query("percentile_rank", "asset rd:d " + " ".join(f"{c}_rank:8" for c in _R), "ret", "SELECT asset, rd, " + ", ".join(f"coalesce({rank_sql(c)}, 0.5) AS {c}_rank" for c in _R) + " FROM ret")(
    lambda s: XS.percentile_ranks(XS.calendar_returns(s.bars(), s.keys()), ["rd"], ["asset"], _R))
query("rank01", "asset rd:d close_rank:8", "mclose", f"SELECT asset, rd, {rank_sql('close')} AS close_rank FROM mclose")(
    lambda s: XS.percentile_ranks(s.month_closes(), ["rd"], ["asset"], ["close"], null_fill=None))
query("robust_z", "asset rd:d a:6 b:6", "ret", f"SELECT asset, rd, a.z AS a, b.z AS b FROM {z_sql('ret', 'ret_3m')} a JOIN {z_sql('ret', 'ret_12_1m')} b USING (asset, rd)")(
    lambda s: XS.robust_z(XS.calendar_returns(s.bars(), s.keys()), ["rd"], ["asset"], _R).withColumnsRenamed({"ret_3m_z": "a", "ret_12_1m_z": "b"}))
query("sector_neutral_rank", "asset rd:d sector_key close_sector_rank:8 market_cap_sector_rank:8", "mcap", f"""
    SELECT asset, rd, sector_key, {rank_sql('close', 'rd, sector_key')} AS close_sector_rank, {rank_sql('market_cap', 'rd, sector_key')} AS market_cap_sector_rank FROM (
      SELECT asset, snapshot_date AS rd, market_cap, market_cap / listed_shares AS close, market || '_' || CASE WHEN market_cap < 5e11 THEN 'small' WHEN market_cap < 2e12 THEN 'mid' WHEN market_cap < 1e13 THEN 'large' ELSE 'mega' END AS sector_key FROM mcap)""")(
    lambda s: XS.sector_neutral_ranks(s.mcap().select("asset", F.col("snapshot_date").alias("rd"), F.col("market").alias("exchange"), "market_cap", (F.col("market_cap") / F.col("listed_shares")).alias("close")), ["close", "market_cap"]))
query("rank_in_date", "asset rd:d close:2 rank:i", "mclose", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rd ORDER BY close DESC, asset) AS rank FROM mclose) WHERE rank <= 20")(
    lambda s: XS.rank_in_date(s.month_closes(), "close", 20))
add_cte("mscore", "mom", f"""
    SELECT asset, rd, (0.5 * coalesce(a.z, 0) + 0.3 * coalesce(b.z, 0) + 0.2 * coalesce(c.z, 0)) / 1.0 AS momentum_score
    FROM {z_sql('mom', 'ret_12_1m')} a JOIN {z_sql('mom', 'ret_6m')} b USING (asset, rd) JOIN {z_sql('mom', 'rs_kospi_12m')} c USING (asset, rd)""")
query("momentum_score", "asset rd:d momentum_score:6", "mscore", "SELECT * FROM mscore")(lambda s: XS.momentum_score(momentum(s)))


def scored(s):
    """Momentum score per (asset, rd), rounded so that ranking does not hang on the last bits of a double."""
    return XS.momentum_score(momentum(s)).select("asset", "rd", F.round("momentum_score", 9).alias("score"))


add_cte("scored", "mscore", "SELECT asset, rd, round(momentum_score, 9) AS score FROM mscore")
query("topn_per_date", "asset rd:d score:6 rank:i", "scored", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rd ORDER BY score DESC, asset) AS rank FROM scored) WHERE rank <= 10")(
    lambda s: XS.rank_in_date(scored(s), "score", 10))
query("weighted_blend", "asset rd:d blend:8", "mom", "SELECT asset, rd, (0.4 * ret_3m + 0.2 * ret_6m) / (0.4::DOUBLE + 0.2::DOUBLE) AS blend FROM mom")(
    lambda s: (lambda m: m.withColumn("blend", weighted_blend(m.columns, {"ret_3m": 0.4, "absent": 0.3, "ret_6m": 0.2})))(momentum(s)))
query("strict_session_returns", "sector status n_sessions:i ret_20:8 rs_20:8 ret_240:8 rs_240:8", "daily assets mkt", """
    SELECT s.sector, CASE WHEN coalesce(latest, -1) <> 0 THEN 'latest_session_missing' WHEN n < 241 THEN 'incomplete_window' ELSE 'ok' END AS status, coalesce(n, 0) AS n_sessions,
      CASE WHEN n = 241 AND latest = 0 THEN a0 / a20 - 1 END AS ret_20, CASE WHEN n = 241 AND latest = 0 THEN ln(1 + (a0 / a20 - 1)) - ln(1 + (b0 / b20 - 1)) END AS rs_20,
      CASE WHEN n = 241 AND latest = 0 THEN a0 / a240 - 1 END AS ret_240, CASE WHEN n = 241 AND latest = 0 THEN ln(1 + (a0 / a240 - 1)) - ln(1 + (b0 / b240 - 1)) END AS rs_240
    FROM (SELECT DISTINCT sector FROM assets) s LEFT JOIN (
      SELECT sector, count(*) AS n, min(back) AS latest, max(c) FILTER (back = 0) AS a0, max(c) FILTER (back = 20) AS a20, max(c) FILTER (back = 240) AS a240,
        max(ic) FILTER (back = 0) AS b0, max(ic) FILTER (back = 20) AS b20, max(ic) FILTER (back = 240) AS b240
      FROM (SELECT sector, d, CAST((2 * sum(pv) + 100 * sum(qty)) // (200 * sum(qty)) AS DOUBLE) AS c FROM daily JOIN assets ON asset = lpad(CAST(l_suppkey AS VARCHAR), greatest(6, length(CAST(l_suppkey AS VARCHAR)))::INT, '0') GROUP BY 1, 2)
      JOIN (SELECT d, close AS ic, row_number() OVER (ORDER BY d DESC) - 1 AS back FROM mkt) USING (d) WHERE back < 241 GROUP BY 1) USING (sector)""")(
    lambda s: XS.strict_session_returns(s.sector_bars(), s.market(), "sector"))
