"""Evidence packets and strict snapshots."""

from pyspark.sql import functions as F

from panelspark.catalog.registry import add_cte, query
from panelspark.operators import hygiene as H, packets as PK, xsection as XS
from panelspark.sources import normalize as N, packet_faults as PX, packet_files as PF
from panelspark.sources.files import materialize, scratch
from panelspark.sources.packets import CUTOFF, methodology_packets, moat_packets

_T = ", ".join(f"('{k}', '{v[0][0]}', {v[1]})" for k, v in PK.SOURCE_TYPES.items())
_D = ", ".join(f"({i}, '{n}')" for i, n in enumerate(PK.DIMENSIONS))
add_cte("mev", "", f"""
    SELECT k, c, st, dd, i, dim, j, ((k * 7 + i * 13) % 11) / 10.0::DOUBLE AS a, ((c + i) % 10) / 10.0::DOUBLE AS cf, t.*, 'G' || ((c + i + j) % 3) AS grp, CASE WHEN st = 'F' AND i = 2 AND c % 13 = 0 THEN 'CUSTOMER' ELSE t.aff0 END AS aff,
      CASE WHEN i = 5 AND j = 1 AND k % 17 = 0 THEN 'E-0-0' ELSE 'E-' || i || '-' || j END AS eid, k % 29 * 15 AS age
    FROM (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS st, CAST(o_orderdate AS DATE) AS dd FROM orders), (VALUES {_D}) d(i, dim), (VALUES (0), (1)) e(j)
    JOIN (SELECT *, row_number() OVER () - 1 AS tn FROM (VALUES {_T}) tt(typ, aff0, maxage)) t ON t.tn = (k + i + j) % 8""")
add_cte("mviol", "mev", """
    SELECT DISTINCT k AS packet_id, code FROM (
      SELECT k, 'review_status' AS code FROM mev WHERE st = 'P' UNION ALL SELECT k, 'stale_evidence' FROM mev WHERE age > maxage UNION ALL SELECT k, 'expired_evidence' FROM mev WHERE k % 23 = 0
      UNION ALL SELECT k, 'evidence_raw_sha256' FROM mev WHERE i = 1 AND k % 19 = 0 UNION ALL SELECT k, 'duplicate_evidence_id' FROM (SELECT k FROM mev GROUP BY k, eid HAVING count(*) > 1)
      UNION ALL SELECT k, 'evidence_source_affiliation_mismatch' FROM mev WHERE aff <> aff0 AND NOT (typ = 'OTHER_PRIMARY') UNION ALL SELECT k, 'duplicate_invalidation:' || dim FROM mev WHERE i = 3 AND k % 31 = 0
      UNION ALL SELECT k, 'assessment:' || dim FROM mev WHERE a > 1 UNION ALL SELECT k, 'independent_support_required:' || dim FROM mev WHERE j = 0 AND a > 0.5 AND aff = 'ISSUER')""")
query("moat_violations", "packet_id code", "mviol", "SELECT CAST(packet_id AS VARCHAR) AS packet_id, code FROM mviol")(lambda s: PK.moat_violations(moat_packets(s), CUTOFF))
query("explode_moat_packets", "packet_id dimension evidence_id assessment:2 confidence:2 independence_group source_type source_affiliation direction", "mev",
      "SELECT CAST(k AS VARCHAR) AS packet_id, dim AS dimension, eid AS evidence_id, a AS assessment, cf AS confidence, grp AS independence_group, typ AS source_type, aff AS source_affiliation, CASE j WHEN 0 THEN 'SUPPORT' ELSE 'CHALLENGE' END AS direction FROM mev")(
    lambda s: PK.explode_moat_packets(moat_packets(s)))
query("moat_scores", "packet_id moat_quality_score:8 evidence_confidence:8 weakest_dimension evidence_count:i independent_source_group_count:i source_type_count:i source_affiliation_count:i support_evidence_count:i", "mev mviol", """
    SELECT CAST(k AS VARCHAR) AS packet_id, avg(a) AS moat_quality_score, avg(cf) AS evidence_confidence, arg_min(dim, (a, i)) AS weakest_dimension, count(*) AS evidence_count, count(DISTINCT grp) AS independent_source_group_count, count(DISTINCT typ) AS source_type_count,
      count(DISTINCT aff) AS source_affiliation_count, count(*) FILTER (j = 0) AS support_evidence_count FROM mev WHERE k NOT IN (SELECT packet_id FROM mviol) GROUP BY k""")(lambda s: PK.moat_scores(moat_packets(s), CUTOFF))
_P = ", ".join(f"({i}, '{n}')" for i, n in enumerate(PK.PILLARS))
_L = ", ".join(f"('{k}', '{p}')" for k, v in PK.LENSES.items() for p in v)
add_cte("mpl", "", f"""
    SELECT *, (n - r) / (n - 1.0::DOUBLE) AS peer FROM (SELECT *, CASE WHEN i = 9 AND k % 11 = 0 THEN n + 1 ELSE 1 + (k * 3 + i) % n END AS r FROM (SELECT c_custkey AS k, c_mktsegment AS seg, i, pillar, 3 + (c_custkey + i) % 7 AS n, ((c_custkey * 5 + i * 3) % 21) / 20.0::DOUBLE AS a, ((c_custkey + i) % 9) / 10.0::DOUBLE AS cf,
      (c_custkey + i) % 6 = 0 AS adj FROM customer, (VALUES {_P}) p(i, pillar)))""")
add_cte("mpv", "mpl", """
    SELECT DISTINCT k AS packet_id, code FROM (SELECT k, 'sector_profile' AS code FROM mpl WHERE seg = 'MACHINERY' UNION ALL SELECT k, 'stage_adjustment_reason:' || pillar FROM mpl WHERE adj AND k % 5 = 0 UNION ALL SELECT k, 'peer_rank:' || pillar FROM mpl WHERE r > n
      UNION ALL SELECT k, 'peer_scope:' || pillar FROM mpl WHERE i = 4 AND k % 8 = 0 UNION ALL SELECT k, 'future_peer_snapshot:' || pillar FROM mpl WHERE i = 0 AND k % 9 = 0 UNION ALL SELECT k, 'artifact_review_status:' || pillar FROM mpl WHERE i = 7 AND k % 10 = 0)""")
add_cte("mlens", "mpl", f"SELECT k, lens, avg(a) AS absolute, avg(peer) AS peer FROM mpl JOIN (VALUES {_L}) l(lens, pillar) USING (pillar) GROUP BY 1, 2")
_M = ("2002-06-30T00:00:00+00:00", "methodology-v1", "anchor-v1")
query("methodology_violations", "packet_id code", "mpv", "SELECT CAST(packet_id AS VARCHAR) AS packet_id, code FROM mpv")(lambda s: PK.methodology_violations(methodology_packets(s), *_M))
query("lens_scores", "packet_id lens absolute:7 peer:7", "mlens", "SELECT CAST(k AS VARCHAR) AS packet_id, lens, absolute, peer FROM mlens")(lambda s: PK.lens_scores(methodology_packets(s)))
query("methodology_scores", "packet_id equal_absolute_score:7 equal_peer_score:7 evidence_confidence:7 dispersion_absolute:7 dispersion_peer:7 stage_adjusted_pillar_count:i thin_peer_group_count:i unique_artifact_id_count:i", "mpl mpv mlens", """
    SELECT CAST(p.k AS VARCHAR) AS packet_id, avg(a) AS equal_absolute_score, avg(peer) AS equal_peer_score, avg(cf) AS evidence_confidence, any_value(da) AS dispersion_absolute, any_value(dp) AS dispersion_peer, count(*) FILTER (adj) AS stage_adjusted_pillar_count,
      count(*) FILTER (n < 5) AS thin_peer_group_count, count(DISTINCT (p.k + i) % 4) AS unique_artifact_id_count FROM mpl p JOIN (SELECT k, max(absolute) - min(absolute) AS da, max(peer) - min(peer) AS dp FROM mlens GROUP BY 1) l ON l.k = p.k WHERE p.k NOT IN (SELECT packet_id FROM mpv) GROUP BY p.k""")(
    lambda s: PK.methodology_scores(materialize(methodology_packets(s), "packets"), *_M))


@query("verify_artifact_hashes", "artifact_id status", "", """
    SELECT CAST(page_id AS VARCHAR) AS artifact_id, CASE WHEN html LIKE '%<script%' THEN 'hash_mismatch' ELSE 'verified' END AS status FROM pages UNION ALL SELECT 'doc-' || doc_id, 'unavailable' FROM labels""")
def _(s):
    p = s.table("pages")
    arts = p.select(F.col("page_id").cast("string").alias("artifact_id"), F.encode("html", "UTF-8").alias("content"))
    refs = p.select(F.col("page_id").cast("string").alias("artifact_id"), F.when(F.contains("html", F.lit("<script")), F.sha2("url", 256)).otherwise(F.sha2("html", 256)).alias("sha256"))
    gone = s.table("labels").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("artifact_id"), F.sha2(F.lit("x"), 256).alias("sha256"))
    return PK.verify_artifact_hashes(refs.unionByName(gone), arts, None)


@query("read_artifacts", "artifact_id status", "", """
    SELECT CAST(page_id AS VARCHAR) AS artifact_id, CASE WHEN page_id % 11 = 5 THEN 'unavailable' WHEN strlen(html) + 1 > 30000 THEN 'bytes_invalid' WHEN page_id % 7 = 3 THEN 'hash_mismatch' ELSE 'verified' END AS status FROM pages""")
def _(s):
    """Pages written as files, one each, against a manifest that is wrong for some and names files that are not there."""
    p = s.table("pages").select(F.col("page_id").cast("string").alias("artifact_id"), "page_id", "html")
    folder = scratch(s.spark, "artifacts")
    p.filter("page_id % 11 <> 5").select(F.col("artifact_id").alias("artifact"), "html").write.partitionBy("artifact").text(folder)
    written = F.concat("html", F.lit("\n"))  # a text file ends in a line feed
    refs = p.select("artifact_id", F.when(F.col("page_id") % 7 == 3, F.sha2("html", 256)).otherwise(F.sha2(written, 256)).alias("sha256"))
    return PK.verify_artifact_hashes(refs, PK.read_artifacts(s.spark, folder, r"artifact=([^/]+)/"), 30_000)


add_cte("sbars", "daily assets", "SELECT sector, d, CAST((2 * sum(pv) + 100 * sum(qty)) // (200 * sum(qty)) AS DOUBLE) AS close FROM daily JOIN assets ON asset = lpad(CAST(l_suppkey AS VARCHAR), greatest(6, length(CAST(l_suppkey AS VARCHAR)))::INT, '0') GROUP BY 1, 2")


@query("strict_snapshot_job", "sector n_violations:i n:i digest", "sbars", "SELECT sector, 0 AS n_violations, count(*) AS n, sha256(string_agg(CAST(d AS VARCHAR) || '=' || CAST(CAST(round(close * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY d)) AS digest FROM sbars GROUP BY 1")
def _(s):
    """Registry of sectors: strict returns, guards, registry completeness and a digest per series."""
    bars = s.sector_bars()
    registry = s.assets().select("sector").distinct()
    bad = H.strict_violations(bars, "sector").groupBy("sector").agg(F.sum("n").alias("n_violations"))
    ret = XS.strict_session_returns(bars, s.market(), "sector")
    gaps = H.registry_gaps(ret, registry, "sector").select("sector")
    return N.frame_digest(H.assert_complete(bars, ["close"]), "sector", "d", "close").join(ret, "sector").join(gaps, "sector", "left_anti").join(bad, "sector", "left").fillna(0, ["n_violations"]).drop("n_sessions")


def _packet_files(s, lines, kind: str):
    """Lines written as compressed text files and read back through the schema check. Each query reads them once, so the parse is not written."""
    folder = scratch(s.spark, f"{kind}-packets")
    lines.write.option("compression", "gzip").text(folder)
    return PF.read_packets(s.spark, folder, kind)


def _expected(table: dict, key: str, source: str, parts: list[str]) -> str:
    rows = ", ".join(f"({i}, '{c}')" for i, codes in enumerate(table.values()) for c in codes)
    names = "[" + ", ".join(f"'{p}'" for p in parts) + "]"
    return f"SELECT CAST({key} AS VARCHAR) AS packet_id, code || CASE WHEN code LIKE '%:' THEN {names}[({key} // {PX.SLOTS}) % {len(parts)} + 1] ELSE '' END AS code FROM {source} JOIN (VALUES {rows}) f(slot, code) ON {key} % {PX.SLOTS} = slot"


query("moat_file_violations", "packet_id code", "", _expected(PX.MOAT, "o_orderkey", "orders", PK.DIMENSIONS))(
    lambda s: PK.moat_violations(PF.judged(_packet_files(s, PX.moat_lines(s), "moat")), CUTOFF))
query("methodology_file_violations", "packet_id code", "", _expected(PX.METHODOLOGY, "c_custkey", "customer", PK.PILLARS))(
    lambda s: PK.methodology_violations(PF.judged(_packet_files(s, PX.methodology_lines(s), "methodology")), *_M))
_Q = ", ".join(f"({list(PX.MOAT).index(k)}, '{v}')" for k, v in PX.QUARANTINE.items())
_U = list(PX.MOAT).index("unknown_field")
query("packet_quarantine", "reason n:i shortest:i", "", f"SELECT reason, count(*) AS n, CASE reason WHEN 'not_json' THEN 200 END AS shortest FROM orders JOIN (VALUES {_Q}) f(slot, reason) ON o_orderkey % {PX.SLOTS} = slot GROUP BY 1")(
    lambda s: PF.quarantine(_packet_files(s, PX.moat_lines(s), "moat")).groupBy("reason").agg(F.count("*").alias("n"), F.when(F.col("reason") == "not_json", F.min(F.length("raw"))).alias("shortest")))
query("packet_unknown_fields", "packet_id fields", "", f"SELECT CAST(o_orderkey AS VARCHAR) AS packet_id, '{','.join(sorted(['note', *(f'{d}.certainty' for d in PK.DIMENSIONS)]))}' AS fields FROM orders WHERE o_orderkey % {PX.SLOTS} = {_U}")(
    lambda s: PF.judged(_packet_files(s, PX.moat_lines(s), "moat")).filter(F.size("unknown_fields") > 0).select("packet_id", F.array_join("unknown_fields", ",").alias("fields")))
