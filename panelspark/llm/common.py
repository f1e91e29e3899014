"""Shared folder, landed tables, connected components and small column helpers."""

from __future__ import annotations

import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in local mode alone a temporary one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="panelspark-llm-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/panelspark-llm/{name}-{uuid.uuid4().hex}"
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(there)
    files.deleteOnExit(there)
    return path


def land(df: DataFrame, name: str, compression: str = "snappy", by: str | None = None) -> DataFrame:
    """Write df once below the shared folder and read it back: the copy survives lost executors and cuts the lineage."""
    path = f"{fresh_folder(df.sparkSession, name)}/rows"
    writer = df.write.option("compression", compression)
    (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def land_buckets(df: DataFrame, name: str, key: str, by: str, compression: str = "snappy") -> DataFrame:
    """Like land, in a table with one bucket of `key` for each shuffle partition: grouping by key reads it without a shuffle."""
    spark = df.sparkSession
    folder = fresh_folder(spark, name)
    table = f"panelspark_{name}_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("compression", compression).option("path", f"{folder}/rows")
    writer.partitionBy(by).bucketBy(shuffle_partitions(spark), key).saveAsTable(table)
    return spark.table(table)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """A-Z to lower case and nothing else; lower() is enough where every character is one byte."""
    only_ascii = F.length(c) == F.octet_length(c)
    return F.when(only_ascii, F.lower(c)).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def named(column: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + column.replace("`", "``") + "`")


def spare(df: DataFrame, *names: str) -> list[str]:
    """Each name, lengthened until no column of df (case aside) has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def digest(text: Column) -> Column:
    """64 bits of a text, by which rows without an id, or that share one, are told apart; a missing text counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a long, b long): rows (node, component = smallest node reachable).

    Alternating large and small stars: each round is a handful of equi-joins and
    minima, the number of rounds grows with the logarithm of the longest path.
    Minima combine before the shuffle and every join has unique keys on one side,
    so Spark can split a hub's rows. Nodes without an edge to another node do not appear.
    """
    state = land(_oriented(edges.select("a", "b")), "edges")
    mark = _mark(state)
    while True:
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _oriented(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        state = land(_oriented(small.unionByName(low.select("a", F.col("m").alias("b")))), "edges")
        if (now := _mark(state)) == mark:
            stars = state.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
        mark = now


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())
