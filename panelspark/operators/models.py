"""Classifiers over the feature panel with MLlib: purged folds, ensembles, clusters, bound scoring."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from panelspark.operators import evaluation as EV, labels as LB
from panelspark.operators.xsection import percentile_ranks, rank_in_date
from panelspark.sources.files import materialize

SEED = 42


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Class weights n / (2 n_class) of the labelled rows. The classes' counts, a row each, reach the driver, so no row moves to meet its weight."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c")).collect()
    n = sum(r["_c"] for r in counts)
    weight = F.coalesce(F.lit(None).cast("double"), *[F.when(F.col(label) == r[label], F.lit(n / (2.0 * r["_c"]))) for r in counts if r[label] is not None])
    return df.filter(F.col(label).isNotNull()).withColumn("_wt", weight)


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    clean = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})
    return VectorAssembler(inputCols=features, outputCol="_x").transform(clean)


def _tree(label: str, trees: int, depth: int):
    return GBTClassifier(featuresCol="_x", labelCol=label, weightCol="_wt", maxIter=trees, maxDepth=depth, maxBins=32, seed=SEED, predictionCol="_pd").setProbabilityCol("_pr").setRawPredictionCol("_raw")


def _prob() -> Column:
    return vector_to_array("_pr")[1]


def fit_tree(train: DataFrame, label: str, trees: int = 10, depth: int = 3):
    return _tree(label, trees, depth).fit(balanced(train, label))


def predict(model, df: DataFrame, out: str) -> DataFrame:
    return model.transform(df).withColumn(out, _prob()).drop("_pr", "_raw", "_pd")


def folds_of(panel: DataFrame, n_folds: int, embargo: int) -> list[int]:
    """Usable fold numbers; at most n_folds integers reach the driver."""
    f = LB.sized_folds(panel, LB.fold_dates(panel, n_folds, embargo)).filter("usable")
    return sorted(r[0] for r in f.select("fold").distinct().collect())


def scored_folds(panel: DataFrame, features: list[str], label: str, n_folds: int = 5, embargo: int = 9, trees: int = 10, depth: int = 3, out: str = "p", min_positives: int = 1) -> DataFrame:
    """Test rows of every usable fold scored by a model fitted on that fold's train rows."""
    one = lambda train, test: predict(fit_tree(train, label, trees, depth), test, out)
    return _by_fold(panel, features, label, n_folds, embargo, out, min_positives, one)


def ensemble_folds(panel: DataFrame, features: list[str], label: str, n_folds: int = 5, embargo: int = 9, trees: int = 10, depth: int = 3, min_positives: int = 1) -> DataFrame:
    """The same with the blend of three models, fitted anew for every fold."""
    blend = lambda train, test: Ensemble.fit(train, features, label, trees, depth).predict(test)
    return _by_fold(panel, features, label, n_folds, embargo, "p", min_positives, blend)


def _by_fold(panel: DataFrame, features: list[str], label: str, n_folds: int, embargo: int, out: str, min_positives: int, score) -> DataFrame:
    """score(train, test) of each usable fold, both with the assembled features; a fold with one class alone, or too few positives, scores 0."""
    base = materialize(panel.select("asset", "rd", label, *features), "folds")
    roles = LB.fold_dates(base, n_folds, embargo)
    parts = []
    for k in folds_of(base, n_folds, embargo):
        part = assemble(base.join(roles.filter(F.col("fold") == k), "rd"), features)
        part = materialize(part.drop(*features), "fold")
        train, test = part.filter(F.col("role") == "train"), part.filter(F.col("role") == "test")
        n_pos, n = train.agg(F.sum(label), F.count(F.lit(1))).first()
        if not n_pos or n_pos < min_positives or n_pos == n:
            parts.append(test.withColumn(out, F.lit(0.0)))
        else:
            parts.append(score(train, test))
    keep = ["asset", "rd", "fold", label, out]
    return reduce(lambda a, b: a.unionByName(b), [p.select(*keep) for p in parts])


def train_entry_classifier(panel: DataFrame, features: list[str], label: str, **kw) -> DataFrame:
    """(fold, n_rows, n_pos, auc, precision_at_30) of the purged walk-forward run."""
    s = materialize(scored_folds(panel, features, label, **kw), "scores")
    auc = EV.roc_auc(s, label, "p", ["fold"])
    return auc.join(EV.precision_at_k(s, label, "p", ["fold"], "asset", 30), "fold", "left")


def feature_importance(panel: DataFrame, features: list[str], label: str, trees: int = 10, depth: int = 3) -> DataFrame:
    base = materialize(panel.select(label, *features), "importance")
    m = fit_tree(assemble(base, features), label, trees, depth)
    rows = [(f, float(v)) for f, v in zip(features, m.featureImportances.toArray())]
    return panel.sparkSession.createDataFrame(rows, "feature string, importance double")


def entry_model_job(panel: DataFrame, label: str, path: str, exclude: set[str], max_null_rate: float = 0.5, k: int = 30, engine_version: str = "1", **kw) -> tuple[DataFrame, DataFrame]:
    """(picks, fold metrics): choose the feature columns by null rate, run the purged folds, fit on all rows, store
    the model with its feature list, read it back and rank what it scores per date."""
    from panelspark.operators.hygiene import align_features, select_feature_columns

    base = materialize(panel, "job")
    rates = select_feature_columns(base, {*exclude, label}, max_null_rate).filter("selected")
    features = sorted(r["feature"] for r in rates.collect())  # a name per column of the panel
    x = materialize(align_features(base, features, ["asset", "rd", label])[0], "job-features")
    metrics = train_entry_classifier(x, features, label, **kw)
    save_bound(fit_tree(assemble(x, features), label, kw.get("trees", 10)), path, features, engine_version)
    return rank_in_date(score_batch(path, base, features, engine_version), "p", k, out="rank_in_month"), metrics


def oos_picks(panel: DataFrame, features: list[str], label: str, k: int = 30, **kw) -> DataFrame:
    return rank_in_date(scored_folds(panel, features, label, **kw), "p", k, out="rank_in_month")


def three_sleeve_picks(panel: DataFrame, features: list[str], k: int = 30, **kw) -> DataFrame:
    """Three labels by purged folds, (.5 pre + .5 continuation) x (1 - risk), ranked per date."""
    sleeves = {"p_pre_entry": "is_pre_entry", "p_continuation": "is_continuation", "p_risk": "is_risk"}
    scored = [scored_folds(panel, features, y, out=p, min_positives=5, **kw).drop(y) for p, y in sleeves.items()]
    j = reduce(lambda a, b: a.join(b.drop("fold"), ["asset", "rd"]), scored)
    return rank_in_date(j.withColumn("p_combined", three_sleeve_score()), "p_combined", k, out="rank_in_month")


def three_sleeve_score() -> Column:
    return (0.5 * F.col("p_pre_entry") + 0.5 * F.col("p_continuation")) * (1 - F.col("p_risk"))


def picks_in_sample(panel: DataFrame, features: list[str], label: str, k: int = 30, min_positives: int = 50, trees: int = 10) -> DataFrame:
    base = materialize(panel.select("asset", "rd", label, *features), "insample")
    n_pos = base.agg(F.sum(label)).first()[0] or 0
    if n_pos < min_positives:
        raise ValueError(f"{n_pos} positive rows of {label}; at least {min_positives} are needed")
    x = assemble(base, features)
    return rank_in_date(predict(fit_tree(x, label, trees), x, "p"), "p", k, out="rank_in_month")


class Ensemble:
    """.5 boosted classifier + .4 boosted regressor ranked per date + .1 logistic on standardised features."""

    def __init__(self, tree, ranker, logit, features):
        self.tree, self.ranker, self.logit, self.features = tree, ranker, logit, features

    @classmethod
    def fit(cls, train: DataFrame, features: list[str], label: str, trees: int = 10, depth: int = 3):
        x = balanced(train if "_x" in train.columns else assemble(train, features), label).withColumn("_y", F.col(label).cast("double"))
        tree = _tree(label, trees, depth).fit(x)
        ranker = GBTRegressor(featuresCol="_x", labelCol="_y", weightCol="_wt", maxIter=trees, maxDepth=depth, seed=SEED, predictionCol="_rk").fit(x)
        logit = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_wt", standardization=True, maxIter=50, probabilityCol="_pr", rawPredictionCol="_raw", predictionCol="_pd").fit(x)
        return cls(tree, ranker, logit, features)

    def predict(self, df: DataFrame) -> DataFrame:
        x = predict(self.tree, df if "_x" in df.columns else assemble(df, self.features), "p_tree")
        x = predict(self.logit, self.ranker.transform(x), "p_logit").drop("_x")
        r = percentile_ranks(x, ["rd"], ["asset"], ["_rk"], null_fill=None)
        return r.withColumn("p", 0.5 * F.col("p_tree") + 0.4 * F.col("_rk_rank") + 0.1 * F.col("p_logit")).drop("_rk", "_rk_rank")


def filled_columns(df: DataFrame, features: list[str], max_null: float) -> list[str]:
    """The features with no more than max_null of their values missing; a name per column reaches the driver."""
    from panelspark.operators.hygiene import null_rates

    kept = {r["feature"] for r in null_rates(df, features).filter(F.col("null_rate") <= max_null).collect()}
    return [f for f in features if f in kept]


def fit_dip_model(x: DataFrame, label: str, trees: int = 10) -> dict:
    """A boosted classifier and a random forest on assembled rows."""
    wt = balanced(x, label)
    rf = RandomForestClassifier(featuresCol="_x", labelCol=label, weightCol="_wt", numTrees=20, maxDepth=5, seed=SEED, probabilityCol="_pr", rawPredictionCol="_raw", predictionCol="_pd").fit(wt)
    return {"tree": _tree(label, trees, 3).fit(wt), "forest": rf}


def score_dips(models: dict, x: DataFrame) -> DataFrame:
    """Assembled rows with p = .7 tree + .3 forest."""
    both = predict(models["forest"], predict(models["tree"], x, "_a"), "_b")
    return both.withColumn("p", 0.7 * F.col("_a") + 0.3 * F.col("_b")).drop("_a", "_b")


def dip_classifier_scores(panel: DataFrame, features: list[str], label: str = "label", n_folds: int = 3, embargo: int = 60, trees: int = 10, max_null: float = 0.70) -> DataFrame:
    """Labelled dips, purged by event date: test rows of each fold with p. Columns with too many missing values are left out."""
    base = materialize(panel.filter(F.col(label).isNotNull()).select("asset", F.col("dip_date").alias("rd"), F.col(label).cast("int").alias(label), *features), "dips")
    features = filled_columns(base, features, max_null)
    roles = LB.fold_dates(base, n_folds, embargo)
    parts = []
    for k in folds_of(base, n_folds, embargo):
        part = assemble(base.join(roles.filter(F.col("fold") == k), "rd"), features)
        train, test = part.filter(F.col("role") == "train"), part.filter(F.col("role") == "test")
        n_pos, n = train.agg(F.sum(label), F.count(F.lit(1))).first()
        if not n_pos or n_pos == n:
            parts.append(test.withColumn("p", F.lit(float(bool(n_pos)))))
        else:
            parts.append(score_dips(fit_dip_model(train, label, trees), test))
    return reduce(lambda a, b: a.unionByName(b), [p.select("asset", F.col("rd").alias("dip_date"), "fold", label, "p") for p in parts])


def dip_model_job(panel: DataFrame, features: list[str], store: ModelStore, engine_version: str = "1", label: str = "label", trees: int = 10, max_null: float = 0.70) -> int:
    """Fit on every labelled dip and publish the models with what they were trained on; returns the version.

    Where all dips have one label there is nothing to tell apart: the version has no parts and scores that label.
    """
    base = materialize(panel.filter(F.col(label).isNotNull()).select(F.col(label).cast("int").alias(label), *features), "dip-model")
    n_pos, n = base.agg(F.sum(label), F.count(F.lit(1))).first()
    if not n:
        raise ValueError("no dip has a label")
    kept = filled_columns(base, features, max_null)
    models = fit_dip_model(assemble(base, kept), label, trees) if 0 < n_pos < n else {}
    return store.publish("dip", engine_version, kept, models, n, n_pos)


def scored_dips(panel: DataFrame, store: ModelStore, engine_version: str = "1", version: int | None = None) -> DataFrame:
    """Dips, labelled or not, scored by a published model; refused if it was made by another engine or needs a column the panel lacks."""
    features, models, positive = store.load("dip", engine_version, version)
    missing = [f for f in features if f not in panel.columns]
    if missing:
        raise ValueError(f"the model needs columns the panel lacks: {missing}")
    return score_dips(models, assemble(panel, features)).drop("_x") if models else panel.withColumn("p", F.lit(float(positive)))


class ModelStore:
    """Published models below a folder and a table of their versions; a version counts once its row is in the table."""

    SCHEMA = "name string, version int, engine_version string, feature_cols array<string>, parts array<string>, n_rows bigint, n_positive bigint"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def versions(self) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).json(f"{self.path}/versions")

    def publish(self, name: str, engine_version: str, features: list[str], models: dict, n_rows: int, n_positive: int) -> int:
        version = 1 + (self.versions().filter(F.col("name") == name).agg(F.max("version")).first()[0] or 0)
        for part, model in models.items():
            PipelineModel([model]).write().save(f"{self.path}/{name}/{version}/{part}")
        row = (name, version, engine_version, features, list(models), n_rows, n_positive)
        self.spark.createDataFrame([row], self.SCHEMA).coalesce(1).write.mode("append").json(f"{self.path}/versions")
        return version

    def load(self, name: str, engine_version: str, version: int | None = None) -> tuple[list[str], dict, bool]:
        """(features, models, whether any row it was fitted on was positive) of a version, the newest unless one is named."""
        found = self.versions().filter(F.col("name") == name)
        rows = (found.filter(F.col("version") == version) if version is not None else found.orderBy(F.desc("version"))).limit(1).collect()
        if not rows:
            raise ValueError(f"no published model {name!r}")
        row = rows[0]
        if row.engine_version != engine_version:
            raise ValueError(f"model {name!r} version {row.version} was made by engine {row.engine_version}, not {engine_version}")
        return list(row.feature_cols), {p: PipelineModel.load(f"{self.path}/{name}/{row.version}/{p}").stages[0] for p in row.parts}, row.n_positive > 0


def adversarial_validation(panel: DataFrame, in_test: Column, features: list[str], trees: int = 10, min_rows: int = 50) -> DataFrame:
    """How well a classifier tells test from train rows: area under the curve and the drifting features."""
    base = materialize(panel.select("asset", "rd", in_test.cast("int").alias("y"), *features), "adversarial")
    n1, n = base.agg(F.sum("y"), F.count(F.lit(1))).first()
    if (n1 or 0) < min_rows or n - (n1 or 0) < min_rows:
        raise ValueError(f"{n1} test and {n - (n1 or 0)} train rows; at least {min_rows} of each are needed")
    x = assemble(base, features)
    hold = F.pmod(F.xxhash64("asset", "rd"), F.lit(10)) < 3
    m = fit_tree(x.filter(~hold), "y", trees)
    auc = EV.roc_auc(predict(m, x.filter(hold), "p").withColumn("g", F.lit(1)), "y", "p", ["g"]).select("auc")
    rows = [(f, float(v)) for f, v in zip(features, m.featureImportances.toArray())]
    imp = base.sparkSession.createDataFrame(rows, "feature string, importance double")
    return imp.withColumn("auc", auc.scalar()).orderBy(F.desc("importance"), "feature").limit(10)


def save_bound(model, path: str, features: list[str], engine_version: str) -> None:
    """Model and, beside it, the record of what it was trained with."""
    model.write().overwrite().save(f"{path}/model")
    SparkSession.active().createDataFrame([(engine_version, features)], "engine_version string, feature_cols array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/binding")


def score_batch(path: str, panel: DataFrame, features: list[str], engine_version: str) -> DataFrame:
    """Refuse a model whose recorded engine version or feature list differs, then align the features and predict."""
    from pyspark.ml.classification import GBTClassificationModel

    from panelspark.operators.hygiene import align_features

    rec = panel.sparkSession.read.schema("engine_version string, feature_cols array<string>").json(f"{path}/binding").first()
    if rec is None or rec.engine_version != engine_version or list(rec.feature_cols) != list(features):
        raise ValueError("model binding does not match this engine and feature list")
    aligned, _ = align_features(panel, features, ["asset", "rd"])
    return predict(GBTClassificationModel.load(f"{path}/model"), assemble(aligned, features), "p").select("asset", "rd", "p")


def return_vectors(bars: DataFrame, sessions: DataFrame, lookback: int = 180, max_null: float = 0.30) -> DataFrame:
    """(asset, return_60d, return_20d, x): standardised returns on the last sessions, missing days 0.

    One asset contributes at most `lookback` values, so the collected map is bounded.
    """
    from panelspark.operators.themes import daily_returns

    w = Window.partitionBy(F.lit(1)).orderBy(F.col("d").desc())
    grid = sessions.select("d", (F.row_number().over(w) - 1).alias("back")).filter(F.col("back") < lookback)
    on = daily_returns(bars).join(grid, "d").filter(F.col("ret").isNotNull())
    cum = lambda n: (F.exp(F.sum(F.when(F.col("back") < n, F.log1p("ret")).otherwise(0.0))) - 1)
    a = on.groupBy("asset").agg(F.count(F.lit(1)).alias("_n"), F.map_from_entries(F.collect_list(F.struct("back", "ret"))).alias("_m"), cum(60).alias("return_60d"), cum(20).alias("return_20d"))
    a = a.filter(1 - F.col("_n") / F.lit(float(lookback)) <= max_null)
    vals = F.transform(F.sequence(F.lit(0), F.lit(lookback - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0)))
    a = a.withColumn("_v", vals)
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda x, y: x + y)
    a = a.withColumn("_mu", total(F.col("_v")) / lookback)
    a = a.withColumn("_sd", F.sqrt(total(F.transform("_v", lambda v: (v - F.col("_mu")) * (v - F.col("_mu")))) / (lookback - 1)) + 1e-9)
    return a.select("asset", "return_60d", "return_20d", array_to_vector(F.transform("_v", lambda v: (v - F.col("_mu")) / F.col("_sd"))).alias("x"))


def discover_clusters(vectors: DataFrame, k: int, noise: float | None = None) -> DataFrame:
    """vectors with `cluster`; with `noise`, members farther from their centre than `noise` times the root mean square of the cluster have none."""
    from pyspark.ml.functions import vector_to_array

    v = materialize(vectors, "vectors")
    model = KMeans(k=k, seed=SEED, featuresCol="x", predictionCol="cluster", maxIter=20).fit(v)
    out = model.transform(v)
    if noise is None:
        return out.drop("x")
    centres = v.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, _c array<double>")  # k rows
    square = F.aggregate(F.zip_with(vector_to_array("x"), "_c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
    out = materialize(out.join(centres, "cluster").withColumn("_d", square).drop("x", "_c"), "clusters")
    spread = out.groupBy("cluster").agg(F.avg("_d").alias("_m"))
    far = F.col("_d") > F.col("_m") * noise * noise
    return out.join(spread, "cluster").withColumn("cluster", F.when(~far, F.col("cluster"))).drop("_d", "_m")
