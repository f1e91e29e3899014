"""What keeps time, shuffles and memory from growing faster than the tables: plans, and results against plain ones."""

import datetime as dt
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelspark.catalog import load
from panelspark.functions import rolling as R
from panelspark.operators import asof as A, dip_features as D, episodes as EP, flow as FL, models as M, technical as T, universe as U
from panelspark.operators.ordered import value_positions
from panelspark.operators import packets as PK
from panelspark.sources import normalize as N, packet_files as PF, packets as PS
from panelspark.sources.star import Star
from panelspark.streaming import monitors as MO

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def days(n: int):
    return pd.bdate_range("2020-01-01", periods=n).date


def frame(n: int, seed: int = 1) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    parts = []
    for a in ("A", "B"):
        x = rng.normal(1e6, 3e5, n)
        x[rng.random(n) < 0.1] = np.nan
        x[60:140] = 1234567.89  # a constant stretch has no deviation, whatever its digits
        parts.append(pd.DataFrame({"asset": a, "d": days(n), "x": x, "y": np.round(rng.normal(0, 1e5, n))}))
    return pd.concat(parts, ignore_index=True)


def nulls(df, *cols):
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in cols})


def test_rolling_by_rungs(spark):
    p = frame(300)
    df = nulls(spark.createDataFrame(p), "x", "y")
    wanted = {"x5": ("x", 5, 3), "x20": ("x", 20, 6), "x60": ("x", 60, 20), "y20": ("y", 20, 20), "y50": ("y", 50, 50), "y61": ("y", 61, 1)}
    got = R.with_rolling_z(df, R.series("asset"), wanted)
    assert not [c for c in got.columns if c.startswith("_")]
    got = got.orderBy("asset", "d").toPandas()
    for out, (c, n, need) in wanted.items():
        g = p.groupby("asset")[c].rolling(n, min_periods=max(need, 2))
        mu = g.mean().values
        sd = g.apply(lambda v: np.nanstd(v, ddof=1) if np.ptp(v[~np.isnan(v)]) else 0.0, raw=True).values
        want = np.where(sd > 0, (p[c].values - mu) / np.where(sd > 0, sd, 1), np.nan)
        np.testing.assert_allclose(got[out].astype(float), want, rtol=1e-7, atol=1e-9, err_msg=out)
    m = R.rolling_extremes(df, R.series("asset"), {"hi": ("x", "max"), "lo": ("x", "min")}, 252).orderBy("asset", "d").toPandas()
    g = p.groupby("asset").x.rolling(252, min_periods=1)
    np.testing.assert_array_equal(m.hi.astype(float), g.max().values)
    np.testing.assert_array_equal(m.lo.astype(float), g.min().values)
    m = R.rolling_mean(df, R.series("asset"), "y", 60, "mu", "n").orderBy("asset", "d").toPandas()
    g = p.groupby("asset").y.rolling(60, min_periods=1)
    np.testing.assert_allclose(m.mu, g.mean().values, rtol=1e-9, atol=1e-6)
    np.testing.assert_array_equal(m.n, g.count().values)


def test_no_long_frames(spark):
    """No moving frame of more than seven rows is gone through row by row."""
    s = Star(spark, SF)
    keys = s.keys()
    for df in (FL.ticker_flow_signals(s.flow()), T.bollinger(s.bars()), T.volume_stats(s.bars()), T.extremes_52w(s.bars()), U.avg_trading_value(s.bars(), keys)):
        for n in (20, 50, 60, 252):
            assert f"RowFrame, -{n - 1}, currentrow" not in plan(df)


def test_facts_are_thinned_before_an_asof(spark):
    p = frame(300)
    facts = spark.createDataFrame(p[["asset", "d", "y"]])
    dates = [days(300)[k] for k in (0, 21, 22, 150, 299)] + [dt.date(2030, 1, 1), dt.date(2019, 1, 1)]
    keys = spark.createDataFrame([(a, r) for a in ("A", "B", "C") for r in dates], "asset string, rd date")
    few = A.newest_at(facts, keys, ["asset"], "d")
    assert few.count() == 10
    want = A.asof(keys, facts, ["asset"], "rd", "d", ["y"]).orderBy("asset", "rd").collect()
    assert A.asof(keys, few, ["asset"], "rd", "d", ["y"]).orderBy("asset", "rd").collect() == want
    gaps = facts.filter("day(d) > 20")
    want = A.asof(keys, gaps, ["asset"], "rd", "d", ["y"]).orderBy("asset", "rd").collect()
    assert A.asof(keys, A.newest_at(gaps, keys, ["asset"], "d"), ["asset"], "rd", "d", ["y"]).orderBy("asset", "rd").collect() == want


def test_technical_rows_stay_with_their_asset(spark):
    s = Star(spark, SF)
    text = T.technical_features(s.bars(), s.market())._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text
    assert "_next_fact" in plan(T.technical_at(s.bars(), s.market(), s.keys()))


def test_regime_reads_averages_alone(spark):
    load()
    from panelspark.catalog import flow_macro as FM

    s = Star(spark, SF)
    text = plan(FM.regimes(s))
    assert "atr" not in text and "high_52w" not in text
    keys = s.keys()
    want = T.technical_at(s.bars(), s.market(), keys).select("asset", "rd", "ma_stack_aligned").orderBy("asset", "rd").collect()
    assert T.aligned_at(s.bars(), keys).orderBy("asset", "rd").collect() == want


def test_packets_are_dealt_out(spark):
    s = Star(spark, SF)
    assert "Repartition" in plan(PS.moat_packets(s)) and "Repartition" in plan(PS.methodology_packets(s))


def test_packets_are_not_written_or_joined_whole(spark):
    """Rules and scores read packets as they are made, and only rows of scores meet the violations."""
    registry = load()
    for name in ("moat_violations", "moat_scores"):
        assert "o_orderkey" in plan(registry[name].run(spark, SF))
    text = plan(PK.moat_scores(PS.moat_packets(Star(spark, SF)), PS.CUTOFF))
    assert text.startswith("Join LeftAnti")
    # packets that share an id are judged together, each has its scores; one without an id is never struck out
    good = PS.moat_packets(Star(spark, SF)).join(PK.moat_scores(PS.moat_packets(Star(spark, SF)), PS.CUTOFF).limit(1).select("packet_id"), "packet_id", "left_semi")
    late = good.withColumn("review_status", F.lit("DRAFT"))
    assert PK.moat_scores(good.unionByName(good), PS.CUTOFF).count() == 2
    assert PK.moat_scores(good.unionByName(late), PS.CUTOFF).count() == 0
    assert PK.moat_scores(late.withColumn("packet_id", F.lit(None).cast("string")), PS.CUTOFF).count() == 1


def test_reasons_are_found_without_the_whole_parse(spark, tmp_path):
    lines = ['{"packet_id": 7, "dimensions": 5}', '{"packet_id": {"a": 1}, "x": 1}', '{"packet_id": " ", "asset_id": "A"}', '{"asset_id": "A"}', '{"packet_id": "p", "dimensions": {"d": {"assessment": "many", "confidence": 0.5, "z": 1}}}', '{"packet_id": "p", "asset', "[1]", '{"packet_id": null}']
    (tmp_path / "p.txt").write_text("\n".join(lines))
    p = PF.read_packets(spark, str(tmp_path), "moat")
    assert sorted((r.raw, r.reason) for r in PF.quarantine(p).collect()) == sorted([(lines[2], "packet_id"), (lines[3], "packet_id"), (lines[5], "not_json"), ("[1]", "packet_object"), (lines[7], "packet_id")])
    got = {r.packet_id: r for r in PF.judged(p).collect()}
    assert set(got) == {"7", '{"a":1}', "p"} and got["7"].dimensions is None and got["p"].dimensions["d"].assessment is None and got["p"].dimensions["d"].confidence == 0.5
    assert got["p"].unknown_fields == ["d.z"] and got['{"a":1}'].unknown_fields == ["x"]
    assert "assessment" not in plan(PF.quarantine(p).select("reason"))
    assert "reconciliation" not in plan(PF.judged(p).select("packet_id"))


def test_first_source_in_parts_of_bounded_size(spark, monkeypatch):
    a = spark.createDataFrame([(k, k * 1.0) for k in range(0, 40, 2)], "k int, v double")
    b = spark.createDataFrame([(k, -k * 1.0) for k in range(40)], "k int, v double")
    monkeypatch.setattr(N, "ROWS_PER_TASK", 10)
    got = N.first_available_source([("a", a), ("b", b)], ["k"])
    assert "RepartitionByExpression [k" in plan(got) and ", 7" in plan(got)
    assert {r.k: (r.v, r.source_identity) for r in got.collect()} == {k: (k * 1.0, "a") if k % 2 == 0 else (-k * 1.0, "b") for k in range(40)}


def test_class_weights_move_no_rows(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 3.0), (1, 4.0), (None, 5.0)], "y int, x double")
    got = M.balanced(df, "y")
    assert "Join" not in plan(got)
    assert sorted((r.y, r.x, r._wt) for r in got.collect()) == [(0, 1.0, 5 / 6), (0, 2.0, 5 / 6), (0, 3.0, 5 / 6), (1, 4.0, 2.5)]


def test_keys_and_month_closes_land_once(spark):
    s = Star(spark, SF)
    for df in (s.keys(), s.month_closes()):
        assert "Aggregate" not in plan(df) and "Window" not in plan(df)
    again = Star(spark, SF)
    assert again.month_closes().inputFiles() == s.month_closes().inputFiles()
    assert s.month_closes().count() == s.keys().count()


def test_sizes_of_groups_are_read_in_both_branches(spark):
    """The ranges of a value and their offsets are worked out from one aggregation."""
    df = spark.createDataFrame([(k % 3, float(k % 50)) for k in range(300)], "g int, v double")
    stats = [line for line in plan(value_positions(df, ["g"], "v")).splitlines() if "collect_list" in line]
    assert len(stats) == 2 and all("sum(eq" in line for line in stats)
    got = {(r.g, r.v): (r.lt, r.eq, r.n) for r in value_positions(df, ["g"], "v").collect()}
    vals = [float(k % 50) for k in range(300) if k % 3 == 1]
    assert got[1, 7.0] == (sum(v < 7 for v in vals), vals.count(7.0), 100)


def test_peaks_of_dips_without_long_frames(spark):
    s = Star(spark, SF)
    for df in (D.numbered(s.bars()), EP.dip_candidates(s.bars())):
        assert "RowFrame, -30, " not in plan(df)


def test_days_land_in_one_file_a_bucket(spark, tmp_path):
    rows = [(f"{a:06d}", dt.date(2020, 1, d), 100.0, 99.0, 101.0, 1.0, 1.0) for a in range(400) for d in (1, 2)]
    days_in = spark.createDataFrame(rows, "asset string, d date, close double, low double, high double, foreign_net double, inst_net double")
    days_in.repartition(1).write.parquet(str(tmp_path / "in"))
    out = MO.run_dip_alerts(MO.stream_of(spark, str(tmp_path / "in"), days_in.schema), "one-file")
    assert out.count() == 800
    folder = Path(next(p for p in out.inputFiles()).removeprefix("file:").replace("%3D", "=").split("/data/")[0])
    for bucket in folder.glob("days/batch=0/bucket=*"):
        assert len(list(bucket.glob("*.parquet"))) == 1


def test_smoothing_sorts_narrow_rows(spark):
    s = Star(spark, SF)
    text = plan(T.technical_features(s.bars(), s.market()))
    assert text.rindex("_b#") > text.rindex("high_52w")  # printed last is done first


def test_few_rows_are_read_around_a_dip(spark):
    """Bars are marked where they lie, 60 rows back answer every range but the long averages and the yearly high, and rows meet dips once."""
    p = frame(300)
    bars = spark.createDataFrame(p.assign(close=p.y.abs() % 50 + 900, volume=p.y.abs() + 1)[["asset", "d", "close", "volume"]])
    bars = bars.select("asset", "d", "close", (F.col("close") + 5).alias("high"), (F.col("close") - 5).alias("low"), "volume", (F.col("close") * F.col("volume")).alias("value"))
    bars = bars.withColumn("close", F.when(F.dayofmonth("d") != 13, F.col("close")))  # a close may be missing
    dips = spark.createDataFrame([(a, days(300)[k]) for a in ("A", "B", "C") for k in (10, 70, 251, 252, 260, 299)], "asset string, dip_date date")
    got = D.bar_features(bars, dips.union(dips))
    assert plan(got).count("Join ") == 1 and "-252" not in plan(got)
    got = {(r.asset, r.t): r for r in got.collect()}
    assert set(got) == {(a, k) for a in ("A", "B") for k in (10, 70, 251, 252, 260, 299)}
    for a in ("A", "B"):
        c = [r.close for r in bars.filter(F.col("asset") == a).orderBy("d").collect()]
        for k in (10, 70, 251, 252, 260, 299):
            known = lambda lo, hi: [v for v in c[lo:hi] if v is not None]
            for n, name in ((50, "f_dist_from_50_ma"), (200, "f_dist_from_200_ma")):
                want = c[k] / np.mean(known(k - n, k)) - 1 if k >= n and c[k] is not None else None
                assert (got[a, k][name] is None) == (want is None) and (want is None or abs(got[a, k][name] - want) < 1e-9)
            want = c[k] / max(known(k - 252, k + 1)) - 1 if k >= 252 and c[k] is not None else None
            assert (got[a, k].f_dist_from_52w_high is None) == (want is None) and (want is None or abs(got[a, k].f_dist_from_52w_high - want) < 1e-9)
