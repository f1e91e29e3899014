"""Model training, scoring and evaluation. Fits have no SQL counterpart; the metrics do."""

from pyspark.sql import functions as F

from panelspark.catalog.episodes import dip_panel, episodes
from panelspark.catalog.fundamental_events import E, event_universe
from panelspark.catalog.registry import add_cte, query
from panelspark.operators import evaluation as EV, hygiene as H, labels as LB, models as M, xsection as XS
from panelspark.sources.files import input_state, landed, scratch

FAST = dict(n_folds=5, trees=5)
LABELS = ["is_pre_surge", "is_pre_entry", "is_continuation", "is_risk"]


def panel(s):
    """The scored panel with all four labels, landed once for each state of the input."""
    from panelspark.catalog.plans import ALL, CFG, PL, inputs

    def build():
        x = PL.scored_panel(inputs(s), CFG, ALL)
        labels = LB.label_risk(LB.label_windows(s.keys(), episodes(s)).join(LB.forward_returns(s.month_closes()).drop("close"), ["asset", "rd"]), -0.10)
        return x.join(labels.select("asset", "rd", *LABELS), ["asset", "rd"])

    return s.landed("scored-panel", ["lineitem", "part", "orders", "supplier"], build)


def columns(p, max_null_rate: float = 0.5):
    """Every numeric column of the panel that is filled often enough, labels and sizes apart."""
    chosen = H.select_feature_columns(p, {"asset", "rd", "market_cap", *LABELS}, max_null_rate).filter("selected")
    return sorted(r["feature"] for r in chosen.select("feature").collect())  # a name per column


def on_panel(job):
    """A query that runs job(panel, its feature columns)."""
    return lambda s: job(p := panel(s), columns(p))


add_cte("sc", "", "SELECT d.doc_id, quality AS y, (n_chars % 997) / 997.0::DOUBLE AS p, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS fold FROM documents d JOIN labels l ON l.doc_id = d.doc_id")


def scored(s):
    return s.table("documents").join(s.table("labels"), "doc_id").select("doc_id", F.col("quality").alias("y"), (F.col("n_chars") % 997 / 997.0).alias("p"), F.when(F.col("lang") == "en", 1).otherwise(0).alias("fold"))


query("calibration_table", "bin_low:2 bin_high:2 n:i predicted_mean:8 actual_rate:8 abs_error:8", "sc", """
    SELECT bin_low, bin_high, count(*) AS n, avg(p) AS predicted_mean, avg(y) AS actual_rate, abs(avg(p) - avg(y)) AS abs_error FROM sc JOIN (VALUES (0.0, 0.1), (0.1, 0.3), (0.3, 0.5), (0.5, 0.7), (0.7, 0.85), (0.85, 1.01)) b(bin_low, bin_high) ON p >= bin_low AND p < bin_high GROUP BY 1, 2""")(
    lambda s: EV.calibration_table(scored(s), "y", "p"))
query("confusion_matrix", "actual:i predicted:i n:i", "sc", "SELECT y AS actual, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS predicted, count(*) AS n FROM sc GROUP BY 1, 2")(lambda s: EV.confusion_matrix(scored(s), "y", "p"))
query("roc_auc", "fold:i n_rows:i n_pos:i auc:8", "sc", """
    SELECT fold, count(*) AS n_rows, sum(y) AS n_pos, (sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS auc
    FROM (SELECT *, rank() OVER (PARTITION BY fold ORDER BY p) + (count(*) OVER (PARTITION BY fold, p) - 1) / 2.0::DOUBLE AS r FROM sc) GROUP BY 1""")(lambda s: EV.roc_auc(scored(s), "y", "p", ["fold"]))
query("precision_at_k", "fold:i precision_at_30:8", "sc", "SELECT fold, avg(y) AS precision_at_30 FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY p DESC, doc_id) AS r FROM sc) WHERE r <= 30 GROUP BY 1")(
    lambda s: EV.precision_at_k(scored(s), "y", "p", ["fold"], "doc_id"))
query("risk_bins", "risk_bin n:i", "gov", "SELECT CASE WHEN r <= 0.1 THEN 'clean' WHEN r <= 0.3 THEN 'low' WHEN r <= 0.5 THEN 'mid' WHEN r <= 0.7 THEN 'high' ELSE 'max' END AS risk_bin, count(*) AS n FROM (SELECT governance_risk_score AS r FROM gov) GROUP BY 1")(
    lambda s: EV.risk_bins(E.governance_scores(s.disclosures(), event_universe(s))))
query("three_sleeve_score", "asset rd:d p_combined:8", "mom", "SELECT asset, rd, (0.5 * ret_3m + 0.5 * ret_6m) * (1 - ret_1m) AS p_combined FROM mom")(
    lambda s: XS.momentum_features(s.bars(), s.index_bars(), s.keys()).withColumnsRenamed({"ret_3m": "p_pre_entry", "ret_6m": "p_continuation", "ret_1m": "p_risk"}).withColumn("p_combined", M.three_sleeve_score()))
add_cte("vec", "bars cal", """
    SELECT asset, count(*) AS n, exp(sum(CASE WHEN back < 60 THEN ln(1 + ret) ELSE 0 END)) - 1 AS return_60d, exp(sum(CASE WHEN back < 20 THEN ln(1 + ret) ELSE 0 END)) - 1 AS return_20d
    FROM (SELECT asset, d, close / lag(close) OVER (PARTITION BY asset ORDER BY d) - 1 AS ret FROM bars) JOIN (SELECT d, row_number() OVER (ORDER BY d DESC) - 1 AS back FROM cal) USING (d) WHERE back < 180 AND ret IS NOT NULL GROUP BY 1""")


def vectors(s):
    return M.return_vectors(s.bars(), s.calendar(), 180, 0.95)


query("return_vectors", "asset return_60d:8 return_20d:8", "vec", "SELECT * FROM vec WHERE 1 - n / 180.0 <= 0.95")(vectors)
query("cluster_summary", "sector n_members:i primary_theme themes mean_return_60d:8 mean_return_20d:8 median_mcap:1 leaders", "vec assets themes mcap", """
    SELECT b.sector, n_members, primary_theme, themes, mean_return_60d, mean_return_20d, median_mcap, leaders FROM (
      SELECT sector, count(*) AS n_members, avg(return_60d) AS mean_return_60d, avg(return_20d) AS mean_return_20d, median(mcap) AS median_mcap, string_agg(asset, ',' ORDER BY return_60d DESC, asset) FILTER (r <= 5) AS leaders FROM (
        SELECT v.*, a.sector, m.mcap, row_number() OVER (PARTITION BY sector ORDER BY return_60d DESC, v.asset) AS r FROM vec v JOIN assets a USING (asset)
        JOIN (SELECT asset, arg_max(market_cap, snapshot_date) AS mcap FROM mcap GROUP BY 1) m ON m.asset = v.asset WHERE 1 - n / 180.0 <= 0.95) GROUP BY 1) b
    JOIN (SELECT sector, string_agg(theme || ':' || c, ',' ORDER BY c DESC, theme) AS themes, arg_min(theme, (-c, theme)) AS primary_theme FROM (
        SELECT sector, theme, count(*) AS c FROM vec v JOIN assets a USING (asset) JOIN themes t ON t.asset = v.asset WHERE 1 - n / 180.0 <= 0.95 GROUP BY 1, 2) GROUP BY 1) t ON t.sector = b.sector""")(
    lambda s: EV.cluster_summary(_members(s, vectors(s).drop("x")).join(s.assets().select("asset", "sector"), "asset"), s.themes(), "sector"))


def _members(s, found):
    return found.join(s.mcap().groupBy("asset").agg(F.max_by("market_cap", "snapshot_date").alias("mcap")), "asset")


def _clusters(s):
    """Clusters of monthly returns over the last 60 month ends, where few are missing."""
    monthly = s.month_closes().select("asset", F.col("rd").alias("d"), "close")
    return M.discover_clusters(M.return_vectors(monthly, s.month_ends().select(F.col("rd").alias("d")), 60, 0.30), 4, noise=2.0)


query("discover_theme_clusters", "asset cluster:i return_60d:8")(_clusters)
query("theme_cluster_summary", "cluster:i n_members:i primary_theme themes mean_return_60d:8 mean_return_20d:8 median_mcap:1 leaders")(lambda s: EV.cluster_summary(_members(s, _clusters(s)), s.themes()))
query("cluster_embeddings", "vec_id:i cluster:i")(lambda s: M.discover_clusters(s.table("embeddings").select("vec_id", M.array_to_vector(F.transform("embedding", lambda v: v.cast("double"))).alias("x")), 8))
query("train_entry_classifier", "fold:i n_rows:i n_pos:i auc:4 precision_at_30:4")(on_panel(lambda p, f: M.train_entry_classifier(p, f, "is_pre_surge", **FAST)))
query("feature_importance", "feature importance:6")(on_panel(lambda p, f: M.feature_importance(p, f, "is_pre_surge", trees=5)))
query("oos_picks", "asset rd:d fold:i p:6 rank_in_month:i")(on_panel(lambda p, f: M.oos_picks(p, f, "is_pre_surge", 10, embargo=0, **FAST)))
query("oos_picks_three_sleeve", "asset rd:d p_pre_entry:6 p_continuation:6 p_risk:6 p_combined:6 rank_in_month:i")(on_panel(lambda p, f: M.three_sleeve_picks(p, f, 10, **FAST)))
query("topk_picks_in_sample", "asset rd:d p:6 rank_in_month:i")(on_panel(lambda p, f: M.picks_in_sample(p, f, "is_pre_surge", 10, trees=5)))
query("adversarial_validation", "feature importance:6 auc:4")(on_panel(lambda p, f: M.adversarial_validation(p, F.year("rd") >= 1997, f, trees=5)))


@query("train_ensemble", "asset rd:d fold:i p:6")
def _(s):
    p = panel(s)
    return M.ensemble_folds(p, columns(p), "is_pre_surge", **FAST)


def _dips(s):
    return dip_panel(s).filter(F.col("label").isNotNull())


def dip_columns(dips):
    """All dip features of the panel."""
    return [c for c in dips.columns if c.startswith("f_")]


def dip_store(s):
    """The store in which one job publishes the dip model for a state of the input; other queries only read it."""
    tables = ["lineitem", "part", "orders", "supplier"]
    state = input_state(s.spark, *[f"{s.path}/{t}.parquet" for t in tables])
    return M.ModelStore(s.spark, landed(s.spark, "dip-model", state, lambda folder: M.dip_model_job(d := _dips(s), dip_columns(d), M.ModelStore(s.spark, folder), trees=5)))


query("dip_model_versions", "name version:i engine_version n_rows:i n_positive:i", "dips", "SELECT 'dip' AS name, 1 AS version, '1' AS engine_version, count(label) AS n_rows, sum(label) AS n_positive FROM dips")(lambda s: dip_store(s).versions())
query("train_dip_classifier", "asset dip_date:d fold:i label:i p:6")(lambda s: M.dip_classifier_scores(d := _dips(s), dip_columns(d), n_folds=5, trees=5))


@query("score_batch", "asset rd:d p:6")
def _(s):
    p, path = panel(s), scratch(s.spark, "model")
    M.save_bound(M.fit_tree(M.assemble(p, f := columns(p)), "is_pre_surge", 5), path, f, "1")
    return M.score_batch(path, p, f, "1")


@query("entry_model_job", "asset rd:d p:6 rank_in_month:i")
def _(s):
    return M.entry_model_job(panel(s), "is_pre_surge", scratch(s.spark, "entry-model"), {"asset", "rd", "market_cap", *LABELS}, k=10, **FAST)[0]


@query("entry_model_metrics", "fold:i n_rows:i n_pos:i auc:4 precision_at_30:4")
def _(s):
    return M.entry_model_job(panel(s), "is_pre_surge", scratch(s.spark, "entry-model"), {"asset", "rd", "market_cap", *LABELS}, k=10, **FAST)[1]
