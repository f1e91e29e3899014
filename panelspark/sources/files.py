"""File sources and sinks."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder; a local one only where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = tempfile.mkdtemp(prefix="panelspark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts the lineage of a frame that several branches read.

    The copy is on shared storage, so a lost executor costs nothing but the tasks it was running.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int = 20_000, keys: list[str] | None = None) -> DataFrame:
    """df dealt out in parts of about `rows` rows, by keys if there are any; for rows that grow much in what follows, or that are put together."""
    return df.repartition(df.count() // rows + 1, *(keys or []))


def input_state(spark: SparkSession, *paths: str) -> str:
    """A digest of names, sizes and times of the files below the paths: it changes when anything is added, replaced or taken away."""
    found = []
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True)
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


#: Folders of landed tables by application, name and state of the input.
_LANDED: dict[tuple[str, str, str], str] = {}


def landed(spark: SparkSession, name: str, state: str, build: Callable[[str], None]) -> str:
    """The folder build(folder) filled for this name and input state; built anew in each application and for each state."""
    key = (spark.sparkContext.applicationId, name, state)
    if key not in _LANDED:
        folder = scratch(spark, name)
        build(folder)
        _LANDED[key] = folder
    return _LANDED[key]


def read_dated_snapshots(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Stack per-date snapshot files; the date is the eight digits before `.parquet` in the path.

    Files without a valid date in their name are skipped.
    """
    day = F.regexp_extract(F.col("_metadata.file_path"), r"_(\d{8})\.parquet", 1)
    return (
        spark.read.option("recursiveFileLookup", "true").parquet(path)
        .select(*columns, F.try_to_date(F.nullif(day, F.lit("")), "yyyyMMdd").alias("snapshot_date"))
        .filter(F.col("snapshot_date").isNotNull())
    )


def write_dated_snapshots(df: DataFrame, path: str, prefix: str = "mktcap_ALL_") -> None:
    """One folder per snapshot date, named like the files `read_dated_snapshots` expects."""
    name = F.concat(F.lit(prefix), F.date_format("snapshot_date", "yyyyMMdd"), F.lit(".parquet"))
    df.withColumn("snap", name).drop("snapshot_date").write.mode("errorifexists").partitionBy("snap").parquet(path)


def write_panel(df: DataFrame, path: str, by: str = "rebalance_date") -> None:
    """One shuffle on the partition column, so each date is written by few tasks; AQE splits big dates."""
    df.repartition(by).write.mode("errorifexists").partitionBy(by).parquet(path)


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


PICKS_SCHEMA = T.StructType([
    T.StructField("rebalance_date", T.DateType()),
    T.StructField("ticker", T.StringType()),
    T.StructField("market_cap", T.DoubleType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("rank_in_month", T.IntegerType()),
])


def write_portfolio_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def read_picks_csv(spark: SparkSession, path: str, schema: T.StructType = PICKS_SCHEMA) -> DataFrame:
    """CSV with header; an explicit schema keeps identifiers as text, the reader drops a byte-order mark."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)


def write_report_json(df: DataFrame, path: str) -> None:
    """Metrics as JSON: one record per row of a small report frame."""
    df.write.mode("errorifexists").json(path)


REGISTRY_SCHEMA = "key string, name string, members array<string>, period_start date, period_end date"


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """Theme or group registry landed as JSON lines -> one row per (key, member)."""
    reg = spark.read.schema(REGISTRY_SCHEMA).json(path)
    return reg.select("key", "name", F.explode("members").alias("asset"), "period_start", "period_end")


CORP_SCHEMA = "corp_code string, corp_name string, stock_code string, modify_date string"


def read_corp_codes_xml(spark: SparkSession, path: str) -> DataFrame:
    """Corporate registry XML; listed issuers are those with a six-character stock code."""
    raw = spark.read.format("xml").option("rowTag", "list").schema(CORP_SCHEMA).load(path)
    code = F.trim("stock_code")
    return raw.filter(F.length(code) == 6).select(
        "corp_code", "corp_name", code.alias("asset"), F.try_to_date("modify_date", "yyyyMMdd").alias("modify_date")
    )
