"""Alerts and streaming jobs."""

from pyspark.sql import functions as F

from panelspark.functions.scalars import padded
from panelspark.catalog.registry import add_cte, query
from panelspark.sources import files
from panelspark.sources.files import scratch
from panelspark.streaming import monitors as MO

add_cte("pf", "assets", "SELECT asset FROM assets WHERE exchange = 'KOSPI'")


def portfolio(s):
    return s.assets().filter(F.col("exchange") == "KOSPI")


_HI = "event_category IN (" + ", ".join(f"'{c}'" for c in MO.HIGH) + ")"
_WA = "event_category IN (" + ", ".join(f"'{c}'" for c in MO.WATCHED) + ")"
add_cte("evalert", "disc pf", f"SELECT d.asset, rcept_no, rcept_dt, event_category, CASE WHEN {_HI} THEN 'HIGH' ELSE 'INFO' END AS severity FROM disc d JOIN pf USING (asset) WHERE {_WA}")
query("event_alerts", "asset rcept_no rcept_dt:d event_category severity", "evalert", "SELECT * FROM evalert")(lambda s: MO.event_alerts(s.disclosures(), portfolio(s)))
query("alert_summary", "severity event_category n:i", "evalert", "SELECT severity, event_category, count(*) AS n FROM evalert GROUP BY 1, 2")(
    lambda s: MO.alert_summary(MO.event_alerts(s.disclosures(), portfolio(s)), ["severity", "event_category"]))


@query("event_alert_stream", "asset rcept_no rcept_dt:d event_category severity", "evalert", "SELECT DISTINCT * FROM evalert")
def _(s):
    src = scratch(s.spark, "disclosures")
    d = s.disclosures().select("asset", "rcept_no", "rcept_dt", "event_category", F.col("rcept_dt").cast("timestamp").alias("ts"))
    d.unionByName(d).write.parquet(src)
    events = MO.stream_of(s.spark, src, d.schema)
    return MO.run_available(MO.event_alert_stream(events, portfolio(s)), "event-alerts")


add_cte("raw5", "bars flow pf mcap", """
    SELECT x.*, m.market_cap FROM (SELECT b.asset, b.d, close AS today_close, d1, d5, f5, i5 FROM (SELECT asset, d, close, close / lag(close) OVER w - 1 AS d1, min(low) OVER v / max(high) OVER v - 1 AS d5 FROM bars WHERE asset IN (SELECT asset FROM pf)
        WINDOW w AS (PARTITION BY asset ORDER BY d), v AS (PARTITION BY asset ORDER BY d ROWS 4 PRECEDING)) b
      LEFT JOIN (SELECT asset, d, sum(foreign_net) OVER v AS f5, sum(inst_net) OVER v AS i5 FROM flow WINDOW v AS (PARTITION BY asset ORDER BY d ROWS 4 PRECEDING)) f ON f.asset = b.asset AND f.d = b.d) x ASOF LEFT JOIN mcap m ON m.asset = x.asset AND x.d >= m.snapshot_date""")
add_cte("dipal", "raw5", """
    SELECT asset, d, today_close, d1 AS dip_1d_pct, d5 AS dip_5d_pct, th AS flow_threshold, CASE WHEN f > th AND i >= 0 THEN 'LIKELY_SHAKEOUT' WHEN f < -th OR i < -th THEN 'LIKELY_DISTRIBUTION' ELSE 'AMBIGUOUS' END AS verdict,
      CASE WHEN f > th AND i >= 0 THEN CASE WHEN i > th THEN 'HIGH' ELSE 'MEDIUM' END WHEN f < -th OR i < -th THEN CASE WHEN f < -th AND i < -th THEN 'HIGH' ELSE 'MEDIUM' END ELSE 'LOW' END AS confidence, CASE WHEN d1 < -0.1 OR d5 < -0.2 THEN 'HIGH' ELSE 'INFO' END AS severity
    FROM (SELECT *, coalesce(f5, 0) AS f, coalesce(i5, 0) AS i, greatest(coalesce(market_cap, 0) * 1e-6, 2e6) AS th FROM raw5) WHERE d1 < -0.05 OR d5 < -0.1""")
query("dip_alerts", "asset d:d today_close:2 dip_1d_pct:8 dip_5d_pct:8 flow_threshold:1 verdict confidence severity", "dipal", "SELECT * FROM dipal")(
    lambda s: MO.dip_alerts(s.bars(), s.flow(), s.mcap(), portfolio(s), flow_share=1e-6, flow_min=2e6))
_SET = {"dip_1d": MO.DIP_1D, "dip_5d": MO.DIP_5D, "flow_share": 1e-6, "flow_min": 2e6}
query("dip_alert_summary", "verdict severity n:i dip_1d:4 dip_5d:4 flow_share:9 flow_min:1", "dipal", "SELECT verdict, severity, count(*) AS n, -0.05 AS dip_1d, -0.1 AS dip_5d, 1e-6 AS flow_share, 2e6 AS flow_min FROM dipal GROUP BY 1, 2")(
    lambda s: MO.alert_summary(MO.dip_alerts(s.bars(), s.flow(), s.mcap(), portfolio(s), **_SET), ["verdict", "severity"], _SET))


@query("dip_alert_stream", "asset d:d today_close:2 dip_1d_pct:8 dip_5d_pct:8 flow_threshold:1 verdict confidence severity", "dipal", "SELECT * FROM dipal")
def _(s):
    """Bars and flows land as files, which a stream takes as three batches or more; the last days of each third come late."""
    src = scratch(s.spark, "days")
    days = s.bars().select("asset", "d", "close", "low", "high").join(s.flow().select("asset", "d", "foreign_net", "inst_net"), ["asset", "d"], "full_outer")
    files.materialize(days, "all-days").repartition(3).write.parquet(src)
    return MO.dip_alert_stream(MO.stream_of(s.spark, src, days.schema, 1), s.mcap(), portfolio(s), **_SET)


_TICK = "strftime({c}, '%Y-%m-%d %H:%M:%S')"
add_cte("dbars", "ticks", """
    SELECT asset, date_trunc('day', ts) AS st, arg_min(price, (ts, event_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, event_id)) AS close, count(*) AS ticks FROM ticks GROUP BY 1, 2""")
_FMT = lambda df: df.withColumns({"start": F.date_format("start", "yyyy-MM-dd HH:mm:ss"), "end": F.date_format("end", "yyyy-MM-dd HH:mm:ss")}).withColumnsRenamed({"start": "start_ts", "end": "end_ts"})
query("bars_from_ticks", "asset start_ts open:2 high:2 low:2 close:2 ticks:i", "dbars", f"SELECT *, {_TICK.format(c='st')} AS start_ts FROM dbars")(lambda s: _FMT(MO.bars_from_ticks(s.ticks())))


@query("bars_from_tick_stream", "asset start_ts open:2 high:2 low:2 close:2 ticks:i", "dbars", f"SELECT *, {_TICK.format(c='st')} AS start_ts FROM dbars")
def _(s):
    raw = MO.stream_of(s.spark, f"{s.path}/events.parquet*", s.table("events").schema)
    last = s.table("supplier").agg(F.max("s_suppkey")).first()[0]
    ticks = raw.select(padded(F.col("user_id") % (last + 1), 6).alias("asset"), "ts", F.col("value").alias("price"), "event_id")
    return _FMT(MO.run_versions(MO.bars_from_ticks(ticks, "1 day"), "tick-bars", ["asset", "start", "end"]))


query("sessions", "asset start_ts end_ts ticks:i amount:2", "ticks", f"""
    SELECT asset, {_TICK.format(c='min(ts)')} AS start_ts, {_TICK.format(c="max(ts) + INTERVAL 30 MINUTE")} AS end_ts, count(*) AS ticks, CAST(sum(CAST(round(price * 100) AS BIGINT)) AS DOUBLE) / 100 AS amount FROM (
      SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY asset ORDER BY ts, event_id) AS g FROM (SELECT *, coalesce(ts >= lag(ts) OVER (PARTITION BY asset ORDER BY ts, event_id) + INTERVAL 30 MINUTE, true) AS gap FROM ticks)) GROUP BY asset, g""")(
    lambda s: _FMT(MO.sessions(s.ticks())))


@query("dip_alerts_scored", "asset dip_date:d p:6 verdict")
def _(s):
    """Every dip, judged by the model another job has published."""
    from panelspark.catalog.episodes import dip_panel
    from panelspark.catalog.models import dip_store
    from panelspark.operators import models as M

    return M.scored_dips(dip_panel(s), dip_store(s)).withColumn("verdict", MO.scored_verdict(F.col("p")))
