"""Monitors that run the same way on batch tables and on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from panelspark.functions.rolling import roll_sum, series
from panelspark.operators.asof import asof
from panelspark.sources.files import scratch

# Categories watched, and the ones that raise a high alert.
HIGH = ["capital_increase", "treasury_sell", "spinoff", "capital_reduction", "convertible_bond", "warrant_bond"]
WATCHED = HIGH + ["treasury_buyback", "insider_holdings"]


def event_alerts(events: DataFrame, portfolio: DataFrame) -> DataFrame:
    """Watched events on held assets with their severity; `portfolio` is the static side."""
    cat = F.col("event_category")
    e = events.filter(cat.isin(WATCHED)).select("asset", "rcept_no", "rcept_dt", "event_category", F.when(cat.isin(HIGH), "HIGH").otherwise("INFO").alias("severity"))
    return e.join(portfolio.select("asset"), "asset", "left_semi")


def event_alert_stream(events: DataFrame, portfolio: DataFrame, delay: str | None = None) -> DataFrame:
    """The same on a stream of events with a timestamp `ts`; repeats of a receipt number are dropped.

    Without a delay no event counts as late, whatever the number of batches. A delay bounds the state of an endless
    stream: it forgets numbers older than that and drops events that come later.
    """
    if delay is None:
        return event_alerts(events.dropDuplicates(["rcept_no"]), portfolio)
    return event_alerts(events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["rcept_no"]), portfolio)


# Default dip and flow thresholds.
DIP_1D, DIP_5D, FLOW_SHARE, FLOW_MIN = -0.05, -0.10, 0.001, 5e8


def dip_verdict(df: DataFrame, dip_1d: float = DIP_1D, dip_5d: float = DIP_5D, flow_share: float = FLOW_SHARE, flow_min: float = FLOW_MIN) -> DataFrame:
    """Verdict, action, confidence and severity from dip_1d_pct, dip_5d_pct, market_cap and five-day flows."""
    f, i = F.coalesce("foreign_net_5d", F.lit(0.0)), F.coalesce("inst_net_5d", F.lit(0.0))
    th = F.greatest(F.coalesce("market_cap", F.lit(0.0)) * flow_share, F.lit(flow_min))
    shake = (f > th) & (i >= 0)
    dist = (f < -th) | (i < -th)
    hit = df.filter((F.col("dip_1d_pct") < dip_1d) | (F.col("dip_5d_pct") < dip_5d))
    return hit.withColumns({
        "flow_threshold": th,
        "verdict": F.when(shake, "LIKELY_SHAKEOUT").when(dist, "LIKELY_DISTRIBUTION").otherwise("AMBIGUOUS"),
        "action": F.when(shake, "HOLD").when(dist, "REVIEW_SELL").otherwise("MANUAL"),
        "confidence": F.when(shake, F.when(i > th, "HIGH").otherwise("MEDIUM")).when(dist, F.when((f < -th) & (i < -th), "HIGH").otherwise("MEDIUM")).otherwise("LOW"),
        "severity": F.when((F.col("dip_1d_pct") < -0.10) | (F.col("dip_5d_pct") < -0.20), "HIGH").otherwise("INFO"),
    })


def dip_alerts(bars: DataFrame, flow: DataFrame, mcap: DataFrame, portfolio: DataFrame, **thresholds) -> DataFrame:
    """Every bar of a held asset that fell far enough, judged by the five-day flows."""
    w = series("asset")
    b = dips(bars.join(portfolio.select("asset"), "asset", "left_semi"))
    fl = flow.select("asset", "d", *[roll_sum(F.col(f"{k}_net"), w, 5, 1).alias(f"{k}_net_5d") for k in ("foreign", "inst", "individual")])
    j = asof(b.join(fl, ["asset", "d"], "left"), mcap, ["asset"], "d", "snapshot_date", ["market_cap"])
    return dip_verdict(j, **thresholds)


def scored_verdict(p: Column, hold: float = 0.65, sell: float = 0.40) -> Column:
    return F.when(p >= hold, "HOLD").when(p < sell, "SELL").otherwise("REDUCE_50")


def alert_summary(alerts: DataFrame, by: list[str], thresholds: dict[str, float] | None = None) -> DataFrame:
    """Counts by the given columns; the thresholds the alerts were raised under are told beside them."""
    return alerts.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).withColumns({k: F.lit(float(v)) for k, v in (thresholds or {}).items()})


# ticks -----------------------------------------------------------------------------------------
def _event_time(df: DataFrame, delay: str | None) -> DataFrame:
    t = df.withColumn("ts", F.col("ts").cast("timestamp"))
    return t.withWatermark("ts", delay) if delay else t


def bars_from_ticks(ticks: DataFrame, length: str = "1 day", delay: str | None = None) -> DataFrame:
    """Open, high, low, close and tick count per asset and time window, on a batch or a stream.

    Every aggregate combines map-side, so a hot asset sends one row per task and window.
    """
    t = _event_time(ticks, delay)
    order = F.struct("ts", "event_id")
    g = t.groupBy("asset", F.window("ts", length).alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count(F.lit(1)).alias("ticks"))
    return g.select("asset", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "open", "high", "low", "close", "ticks")


def sessions(ticks: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """Activity sessions per asset: a pause of the gap ends one.

    Ticks of one gap-long bucket always belong together, so they are summed first, map-side; what is put in order per asset is one
    row per bucket, whatever the number of ticks.
    """
    pause = gap_minutes * 60_000_000
    t = ticks.select("asset", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "price")
    b = t.groupBy("asset", F.floor(F.col("us") / pause).alias("bucket")).agg(
        F.min("us").alias("first"), F.max("us").alias("last"), F.count(F.lit(1)).alias("ticks"), F.sum("price").alias("amount"))
    w = Window.partitionBy("asset").orderBy("bucket")
    opens = F.coalesce(F.col("first") >= F.lag("last").over(w) + pause, F.lit(True)).cast("int")
    g = b.withColumn("_o", opens).withColumn("_s", F.sum("_o").over(w))
    out = g.groupBy("asset", "_s").agg(F.min("first").alias("a"), F.max("last").alias("z"), F.sum("ticks").alias("ticks"), F.sum("amount").alias("amount"))
    return out.select("asset", F.timestamp_micros("a").alias("start"), F.timestamp_micros(F.col("z") + pause).alias("end"), "ticks", "amount")


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, into Parquet with a checkpoint in the shared folder, and read the result."""
    spark = stream.sparkSession
    out = scratch(spark, name)
    q = (stream.writeStream.format("parquet").outputMode(mode).option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def run_versions(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Run an aggregating stream over what is there; each batch writes the rows it changed, the last version of a row counts."""
    spark, out = stream.sparkSession, scratch(stream.sparkSession, name)

    def save(batch: DataFrame, version: int) -> None:
        batch.withColumn("_version", F.lit(version)).write.mode("overwrite").parquet(f"{out}/data/batch={version}")

    stream.writeStream.outputMode("update").option("checkpointLocation", f"{out}/checkpoint").foreachBatch(save).trigger(availableNow=True).start().awaitTermination()
    return _latest(spark, f"{out}/data", T.StructType([*stream.schema.fields, T.StructField("_version", T.LongType())]), keys)


def _latest(spark: SparkSession, path: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    if not spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
        return spark.createDataFrame([], schema).drop("_version")
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "_version")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_version").alias("_r"))
    return last.select(*keys, "_r.*")


def stream_of(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder, or of a table that may be one file or a folder of part files (a path with a `*`).

    Without files_per_trigger all that is there is one batch.
    """
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def dips(bars: DataFrame) -> DataFrame:
    """Each bar with its one-day fall and its five-row range fall."""
    w = series("asset")
    five = w.rowsBetween(-4, 0)
    return bars.select("asset", "d", F.col("close").alias("today_close"), (F.try_divide("close", F.lag("close").over(w)) - 1).alias("dip_1d_pct"),
                       (F.min("low").over(five) / F.max("high").over(five) - 1).alias("dip_5d_pct"))


BUCKETS = 64
_ROW = ["asset", "d", "close", "low", "high", "foreign_net", "inst_net"]


def judged_days(days: DataFrame) -> DataFrame:
    """Days (a bar, a flow, or both of an asset and date) -> each bar with its falls and the sums of the last five flows."""
    w = series("asset")
    bar, five = F.col("close").isNotNull(), w.rowsBetween(-4, 0)
    b = dips(days.filter(bar))
    flow = days.filter(F.col("foreign_net").isNotNull() | F.col("inst_net").isNotNull())
    sums = flow.select("asset", "d", *[F.when(F.count(f"{k}_net").over(five) >= 1, F.sum(f"{k}_net").over(five)).alias(f"{k}_net_5d") for k in ("foreign", "inst")])
    return b.join(sums, ["asset", "d"], "left")


def run_dip_alerts(days: DataFrame, name: str = "dip-alerts") -> DataFrame:
    """Dips from a stream of daily bars and flows that may come in any order and in any number of batches.

    A batch has one file a bucket.

    days has (asset, d, close, low, high, foreign_net, inst_net), bars or flows missing where there are none; rows of one asset and date count as one.
    State is the tail of each asset: its last five bars and five flows. A batch is judged against the tails alone. Only assets
    for which a day comes late are judged anew from their first late day on, from the history kept in one of 64 buckets, of which only
    those with late assets are read. Each batch writes the bars it judged as a version; the last version of each bar counts.
    """
    spark, out = days.sparkSession, scratch(days.sparkSession, name)
    kept = T.StructType([days.schema[c] for c in _ROW])
    schema = T.StructType([*judged_days(spark.createDataFrame([], kept)).schema.fields, T.StructField("_version", T.LongType())])
    one = lambda df: df.groupBy("asset", "d").agg(*[F.max(c).alias(c) for c in _ROW[2:]])

    def tails(df: DataFrame) -> DataFrame:
        """The last five bars and the last five flows of each asset."""
        nth = lambda cond: F.sum(cond.cast("int")).over(Window.partitionBy("asset").orderBy(F.desc("d")))
        bar, flow = F.col("close").isNotNull(), F.col("foreign_net").isNotNull() | F.col("inst_net").isNotNull()
        return df.withColumns({"_b": nth(bar), "_f": nth(flow)}).filter((bar & (F.col("_b") <= 5)) | (flow & (F.col("_f") <= 5))).select(*_ROW)

    def judge(batch: DataFrame, version: int) -> None:
        folder = f"{out}/days/batch={version}"
        one(batch.select(*_ROW)).withColumn("bucket", F.pmod(F.xxhash64("asset"), F.lit(BUCKETS))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        new = spark.read.schema(kept).parquet(folder).select(*_ROW)
        state = spark.read.schema(kept).parquet(f"{out}/tail/version={version - 1}") if version else spark.createDataFrame([], kept)
        last = state.groupBy("asset").agg(F.max("d").alias("last"))
        since = new.groupBy("asset").agg(F.min("d").alias("since")).join(last, "asset", "left").withColumn("late", F.coalesce(F.col("since") <= F.col("last"), F.lit(False)))
        since.write.mode("overwrite").parquet(f"{out}/since/version={version}")
        since = spark.read.parquet(f"{out}/since/version={version}")
        late = since.filter("late").select("asset")
        buckets = [r[0] for r in late.select(F.pmod(F.xxhash64("asset"), F.lit(BUCKETS))).distinct().collect()]  # 64 numbers at most
        on_time = state.join(since.filter("not late").select("asset"), "asset", "left_semi").unionByName(new.join(late, "asset", "left_anti"))
        if buckets:
            history = spark.read.schema(T.StructType([*kept.fields, T.StructField("bucket", T.LongType())])).option("basePath", f"{out}/days").parquet(f"{out}/days")
            again = one(history.filter(F.col("bucket").isin(buckets) & (F.col("batch") <= version)).select(*_ROW).join(late, "asset", "left_semi"))
            on_time = on_time.unionByName(again)
        judged = judged_days(on_time).join(since.select("asset", "since"), "asset").filter("d >= since").drop("since")
        judged.withColumn("_version", F.lit(version).cast("bigint")).write.mode("overwrite").parquet(f"{out}/data/batch={version}")
        untouched = state.join(since.select("asset"), "asset", "left_anti")
        tails(on_time).unionByName(untouched).write.mode("overwrite").parquet(f"{out}/tail/version={version}")

    days.select(*_ROW).writeStream.option("checkpointLocation", f"{out}/checkpoint").foreachBatch(judge).trigger(availableNow=True).start().awaitTermination()
    return _latest(spark, f"{out}/data", schema, ["asset", "d"])


def dip_alert_stream(days: DataFrame, mcap: DataFrame, portfolio: DataFrame, name: str = "dip-alerts", **thresholds) -> DataFrame:
    """The verdicts of dip_alerts from a stream of days; sizes and holdings are the static side."""
    held = run_dip_alerts(days.join(portfolio.select("asset"), "asset", "left_semi"), name)
    return dip_verdict(asof(held, mcap, ["asset"], "d", "snapshot_date", ["market_cap"]), **thresholds)
