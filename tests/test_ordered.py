"""Ranks, quantiles and z-scores against pandas, with groups cut into many ranges and hot ties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import evaluation as EV, ordered as O, xsection as XS


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    n = 3000
    g = np.where(rng.random(n) < 0.34, "hot", rng.integers(0, 6, n).astype(str))
    v = np.where(rng.random(n) < 0.33, 7.0, np.round(rng.normal(0, 50, n), 1))
    v[rng.random(n) < 0.05] = np.nan
    return pd.DataFrame({"rd": g, "asset": [f"a{i:05d}" for i in range(n)], "x": v})


def to_spark(spark, pdf):
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "rd string, asset string, x double")


@pytest.mark.parametrize("every,per_range", [(1, 1), (2, 3), (4096, 16)])
def test_positions_do_not_depend_on_the_cuts(spark, frame, every, per_range):
    pos = O.value_positions(to_spark(spark, frame), ["rd"], "x", every, per_range).toPandas().set_index(["rd", "x"]).sort_index()
    f = frame.dropna()
    want = f.groupby(["rd", "x"]).size()
    assert (pos["eq"] == want).all() and len(pos) == len(want)
    lt = f.groupby("rd")["x"].rank(method="min") - 1
    assert (pos["lt"] == f.assign(lt=lt).groupby(["rd", "x"])["lt"].first()).all()


def test_percentile_rank(spark, frame):
    got = XS.percentile_ranks(to_spark(spark, frame), ["rd"], ["asset"], ["x"]).toPandas().set_index("asset")["x_rank"].sort_index()
    want = frame.groupby("rd")["x"].rank(pct=True).fillna(0.5)
    want.index = frame["asset"]
    assert np.allclose(got, want.sort_index())


def test_quantiles(spark, frame):
    got = O.exact_quantiles(to_spark(spark, frame), ["rd"], "x", {"a": 0.01, "b": 0.5, "c": 0.95}).toPandas().set_index("rd").sort_index()
    for c, q in (("a", 0.01), ("b", 0.5), ("c", 0.95)):
        assert np.allclose(got[c], frame.groupby("rd")["x"].quantile(q).sort_index())


def test_robust_z(spark, frame):
    def z(s):
        v = s.dropna()
        w = s.clip(v.quantile(0.01), v.quantile(0.99))
        m = w.median()
        mad = (w - m).abs().median()
        return pd.Series(0.0, s.index) if mad < 1e-12 else ((w - m) / (1.4826 * mad)).clip(-4, 4)

    got = XS.robust_z(to_spark(spark, frame), ["rd"], ["asset"], ["x"]).toPandas().set_index("asset")["x_z"].sort_index().astype(float)
    want = frame.groupby("rd")["x"].transform(z)
    want.index = frame["asset"]
    assert np.allclose(got, want.sort_index(), equal_nan=True)


def test_auc(spark, frame):
    f = frame.dropna().copy()
    f["y"] = (np.arange(len(f)) % 3 == 0).astype(int)
    df = spark.createDataFrame(f[["rd", "x", "y"]])
    got = EV.roc_auc(df, "y", "x", ["rd"]).toPandas().set_index("rd")["auc"]
    for g, s in f.groupby("rd"):
        p, n = s.loc[s.y == 1, "x"].to_numpy(), s.loc[s.y == 0, "x"].to_numpy()
        brute = ((p[:, None] > n).sum() + 0.5 * (p[:, None] == n).sum()) / (len(p) * len(n))
        assert abs(got[g] - brute) < 1e-12


def test_topk_is_limited_before_the_shuffle(spark, frame):
    plan = XS.rank_in_date(to_spark(spark, frame), "x", 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert plan.index("Partial") > plan.index("Exchange")


def test_robust_z_small_group_is_null(spark):
    df = spark.createDataFrame([("d", f"a{i}", float(i)) for i in range(4)], "rd string, asset string, x double")
    assert XS.robust_z(df, ["rd"], ["asset"], ["x"]).filter(F.col("x_z").isNotNull()).count() == 0


def test_many_distinct_values_and_many_ties(spark):
    """A million distinct values next to 99 % ties of one value, with few values per range."""
    from panelspark.operators.ordered import value_positions

    wide = spark.range(1_000_000).select(F.lit("w").alias("g"), ((F.col("id") * 7919) % 1_000_003).cast("double").alias("v"))
    tied = spark.range(100_000).select(F.lit("t").alias("g"), F.when(F.col("id") % 100 == 0, F.col("id")).otherwise(0).cast("double").alias("v"))
    pos = value_positions(wide.unionByName(tied), ["g"], "v", every=64, per_range=4)
    w = pos.filter("g = 'w'").agg(F.count("*").alias("n"), F.max("lt").alias("m"), F.count_distinct("lt").alias("d")).first()
    assert (w.n, w.m, w.d) == (1_000_000, 999_999, 1_000_000)
    t = {r.v: (r.lt, r.eq, r.n) for r in pos.filter("g = 't'").collect()}
    assert t[0.0] == (0, 99_001, 100_000) and t[100.0] == (99_001, 1, 100_000) and len(t) == 1000


def test_ties_stay_spread_over_tasks(spark):
    """One value holds nearly all rows of its group, nulls as many again: ranks are right and no task gets them all."""
    rows = [(f"a{k}", "g", 7.0 if k % 100 else float(k)) for k in range(8000)] + [(f"n{k}", "g", None) for k in range(8000)]
    pdf = pd.DataFrame(rows, columns=["asset", "rd", "x"])
    held = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = O.average_rank(spark.createDataFrame(rows, "asset string, rd string, x double").repartition(4), ["rd"], "x", "r")
        sizes = out.groupBy(F.spark_partition_id().alias("p")).count().toPandas()
        got = out.toPandas().set_index("asset")["r"].astype(float)
    finally:
        for c, v in held.items():
            spark.conf.set(c, v)
    assert sizes["count"].max() < 0.4 * len(rows)
    want = pdf["x"].rank(pct=True)
    want.index = pdf["asset"]
    assert np.allclose(got.sort_index(), want.sort_index(), equal_nan=True)
