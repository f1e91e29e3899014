"""Nested packets derived from the order and customer tables, with violations spread over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelspark.operators.packets import DIMENSIONS, PILLARS, SOURCE_TYPES
from panelspark.sources.files import spread
from panelspark.sources.star import Star

CUTOFF = "2002-06-30T00:00:00+00:00"


def _iso(d: Column) -> Column:
    return F.concat(d.cast("string"), F.lit("T00:00:00+00:00"))


def _pick(values: list[str], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))


def moat_packets(s: Star) -> DataFrame:
    """One packet per order; two pieces of evidence per dimension. Orders are dealt out first: a packet is hundreds of times the size of its order."""
    k, c, d = F.col("o_orderkey"), F.col("o_custkey"), F.to_date("o_orderdate")
    first = [v[0][0] for v in SOURCE_TYPES.values()]

    def evidence(i: Column, j: Column) -> Column:
        kind = k + i + j
        ver = F.date_sub(d, (k % 29 * 15).cast("int"))
        affiliation = F.when((F.col("o_orderstatus") == "F") & (i == 2) & (c % 13 == 0), F.lit("CUSTOMER")).otherwise(_pick(first, kind))
        ij = F.concat_ws("-", i.cast("string"), j.cast("string"))
        eid = F.when((i == 5) & (j == 1) & (k % 17 == 0), F.lit("E-0-0")).otherwise(F.concat(F.lit("E-"), ij))
        sha = F.when((i == 1) & (k % 19 == 0), F.lit("nothex")).otherwise(F.sha2(F.concat_ws("-", k.cast("string"), ij), 256))
        return F.struct(
            eid.alias("evidence_id"), F.concat(F.lit("S-"), i.cast("string")).alias("source_id"), F.concat(F.lit("G"), ((c + i + j) % 3).cast("string")).alias("independence_group"),
            F.concat(F.lit("A"), c.cast("string")).alias("subject_asset_id"), F.concat(F.lit("I"), c.cast("string")).alias("subject_issuer_id"),
            _pick(list(SOURCE_TYPES), kind).alias("source_type"), affiliation.alias("source_affiliation"), F.when(j == 0, "SUPPORT").otherwise("CHALLENGE").alias("direction"),
            _iso(F.date_sub(ver, 2)).alias("published_at"), _iso(F.date_sub(ver, 1)).alias("available_at"), _iso(ver).alias("verified_at"),
            _iso(F.date_add(d, F.when(k % 23 == 0, -1).otherwise(10))).alias("valid_through"), sha.alias("raw_sha256"), F.lit("claim").alias("claim"),
        )

    def dimension(x: Column) -> Column:
        i = x["i"]
        return F.struct(x["n"].alias("key"), F.struct(
            (((k * 7 + i * 13) % 11) / 10.0).alias("assessment"), (((c + i) % 10) / 10.0).alias("confidence"), F.lit("counter").alias("counter_argument"), F.lit("reconciled").alias("reconciliation"),
            F.array(F.lit("x"), F.when((i == 3) & (k % 31 == 0), F.lit("x ")).otherwise(F.lit("y"))).alias("invalidation_conditions"),
            F.transform(F.array(F.lit(0), F.lit(1)), lambda j: evidence(i, j)).alias("evidence")).alias("value"))

    names = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate(DIMENSIONS)])
    dims = F.map_from_entries(F.transform(names, dimension))
    orders = spread(s.table("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus"))
    return orders.select(
        k.cast("string").alias("packet_id"), F.lit("moat-quality-v2").alias("schema"), F.concat(F.lit("A"), c.cast("string")).alias("asset_id"), F.concat(F.lit("I"), c.cast("string")).alias("issuer_id"),
        _iso(d).alias("as_of"), _iso(F.date_add(d, 1)).alias("reviewed_at"), F.when(F.col("o_orderstatus") == "P", "DRAFT").otherwise("RESEARCH_REVIEWED").alias("review_status"), dims.alias("dimensions"),
    )


def methodology_packets(s: Star) -> DataFrame:
    """One packet per customer. Customers are dealt out first, as orders are."""
    k = F.col("c_custkey")
    d = F.lit("2000-01-31").cast("date")

    def pillar(x: Column) -> Column:
        i = x["i"]
        n = F.lit(3) + (k + i) % 7
        rank = F.when((i == 9) & (k % 11 == 0), n + 1).otherwise(F.lit(1) + (k * 3 + i) % n)
        adjusted = (k + i) % 6 == 0
        art = F.concat(F.lit("art-"), ((k + i) % 4).cast("string"))
        return F.struct(x["n"].alias("key"), F.struct(
            (((k * 5 + i * 3) % 21) / 20.0).alias("absolute_assessment"), (((k + i) % 9) / 10.0).alias("confidence"), F.when(adjusted, "STAGE_ADJUSTED").otherwise("STANDARD").alias("assessment_mode"),
            F.when(adjusted & (k % 5 != 0), "early stage").alias("stage_adjustment_reason"), F.lit("why").alias("absolute_rationale"), F.lit("peers").alias("peer_rationale"), F.lit("but").alias("counter_argument"),
            F.array(F.lit("x")).alias("invalidation_conditions"), F.lit("peer-1").alias("peer_group_id"), F.when((i == 4) & (k % 8 == 0), "MOON").otherwise("GLOBAL_INDUSTRY").alias("peer_scope"), F.lit("r").alias("peer_scope_exception_reason"),
            F.lit("snap-1").alias("peer_snapshot_artifact_id"), F.sha2(F.lit("snap"), 256).alias("peer_snapshot_sha256"), _iso(F.date_add(d, F.when((i == 0) & (k % 9 == 0), 5).otherwise(-5))).alias("peer_as_of"),
            n.cast("bigint").alias("peer_member_count"), rank.cast("bigint").alias("peer_rank"),
            F.array(F.struct(art.alias("artifact_id"), F.lit("MOAT_V2").alias("artifact_type"), F.sha2(art, 256).alias("sha256"), _iso(F.date_sub(d, 3)).alias("available_at"),
                             F.when((i == 7) & (k % 10 == 0), "DRAFT").otherwise("REVIEWED").alias("review_status"))).alias("evidence_refs")).alias("value"))

    names = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate(PILLARS)])
    pillars = F.map_from_entries(F.transform(names, pillar))
    return spread(s.table("customer").select("c_custkey", "c_mktsegment")).select(
        k.cast("string").alias("packet_id"), F.lit("methodology-v1").alias("schema"), F.lit("anchor-v1").alias("assessment_anchor_version"), F.concat(F.lit("A"), k.cast("string")).alias("asset_id"), F.concat(F.lit("I"), k.cast("string")).alias("issuer_id"),
        F.lit("KR").alias("country"), F.lit("EQUITY").alias("asset_class"), F.when(F.col("c_mktsegment") == "MACHINERY", "WIDGETS").otherwise("GENERAL").alias("sector_profile"), _iso(d).alias("as_of"), _iso(F.date_add(d, 2)).alias("reviewed_at"),
        F.lit("RESEARCH_REVIEWED").alias("review_status"), pillars.alias("pillars"),
    )

