"""Evidence packets from files: one JSON object a line or a file, checked against the packet's schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from panelspark.operators.packets import METHODOLOGY_SCHEMA, MOAT_SCHEMA

#: Schema of a packet kind and its map of named parts.
KINDS = {"moat": (MOAT_SCHEMA, "dimensions"), "methodology": (METHODOLOGY_SCHEMA, "pillars")}


def read_packets(spark: SparkSession, path: str, kind: str, whole_files: bool = False) -> DataFrame:
    """All packets below a folder, one row each: the columns of the schema, unknown_fields, reason, raw.

    reason is null for packets that can be judged. Others are for quarantine, with their text in raw: "not_json" (broken off or
    no JSON), "packet_object" (JSON, but not an object), "packet_id" (no id to report under). A field of the wrong type, as a missing one,
    is null, so that the rules that read it fire. Fields the schema does not know break no rule; unknown_fields names
    them, those inside a part as part.field. Empty lines are skipped.
    """
    schema, part = KINDS[kind]
    parsed_type = spark.createDataFrame([], schema).schema
    known = parsed_type[part].dataType.valueType.fieldNames()
    lines = spark.read.text(path, wholetext=whole_files, recursiveFileLookup=True)
    lines = lines.select(F.trim("value").alias("raw")).filter(F.col("raw") != "")
    corrupt = T.StructType([*parsed_type.fields, T.StructField("_corrupt", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    # the id is parsed on its own, without what else is in the text: where only ids and reasons are asked for, the rest is never parsed
    p = lines.select("raw", F.from_json("raw", "packet_id string, _corrupt string", options).alias("_id"), F.from_json("raw", corrupt, options).alias("p"), F.from_json("raw", f"{part} map<string, map<string, string>>").alias("_names"))
    # a wrong type leaves the record whole; what cannot be read at all has no top-level names
    top = F.json_object_keys("raw")
    is_json = F.expr("try_parse_json(raw) is not null")
    reason = F.when(~is_json, "not_json").when(top.isNull(), "packet_object").when(F.coalesce(F.trim("_id.packet_id"), F.lit("")) == "", "packet_id")
    outside = F.array_except(F.coalesce(top, F.array().cast("array<string>")), F.array(*[F.lit(n) for n in parsed_type.fieldNames()]))
    inside = F.flatten(F.transform(F.map_entries(F.coalesce(f"_names.{part}", F.create_map().cast("map<string, map<string, string>>"))), lambda e: F.transform(
        F.array_except(F.coalesce(F.map_keys(e["value"]), F.array().cast("array<string>")), F.array(*[F.lit(n) for n in known])), lambda f: F.concat(e["key"], F.lit("."), f))))
    columns = [F.col("_id.packet_id" if n == "packet_id" else f"p.{n}").alias(n) for n in parsed_type.fieldNames()]
    return p.select(*columns, F.array_sort(F.concat(outside, inside)).alias("unknown_fields"), reason.alias("reason"), "raw")


def judged(packets: DataFrame) -> DataFrame:
    """The packets the rules can be applied to."""
    return packets.filter(F.col("reason").isNull()).drop("reason", "raw")


def quarantine(packets: DataFrame) -> DataFrame:
    """(reason, raw) of the rest."""
    return packets.filter(F.col("reason").isNotNull()).select("reason", "raw")
