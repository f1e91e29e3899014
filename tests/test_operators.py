"""Operators against pandas or brute force on small frames."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from panelspark.functions import scalars as X
from panelspark.functions.ewm import add_ewm
from panelspark.functions.feature_groups import GROUPS, with_feature_group
from panelspark.operators import asof as A, dip_features as D, episodes as EP, evaluation as EV, events as E, flow as FL, fundamental as FU, hygiene as H, labels as LB, models as M, packets as PK, portfolio as P, regime as RG, technical as T, themes as TH, universe as U
from panelspark.operators.around import around
from panelspark.sources import packet_faults as PX, packet_files as PF
from panelspark.sources.star import Star, asset_id
from panelspark.streaming import monitors as MO


def bars_of(seed: int, n: int, assets=("A", "B")) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    out = []
    for a in assets:
        c = np.round(100 * np.exp(np.cumsum(rng.normal(0, 0.03, n))), 2)
        d = pd.bdate_range("2020-01-01", periods=n).date
        out.append(pd.DataFrame({"asset": a, "d": d, "close": c, "high": np.round(c * 1.01, 2), "low": np.round(c * 0.98, 2), "volume": rng.integers(1, 1000, n).astype(float)}))
    return pd.concat(out, ignore_index=True).assign(value=lambda x: x.close * x.volume)


def test_scalars(spark):
    df = spark.createDataFrame([("-1,234",), ("+5.5%",), ("-",), (" n/a",), ("12",)], "s string")
    assert [r[0] for r in df.select(X.parse_number(F.col("s"))).collect()] == [-1234.0, 5.5, None, None, 12.0]
    ids = spark.createDataFrame([("5930",), ("A5930",), ("005930",)], "s string")
    assert [r[0] for r in ids.select(X.normalize_asset(F.col("s"))).collect()] == ["005930", "A5930", "005930"]
    n = spark.createDataFrame([("3.9",), ("NaN",), ("x",)], "s string")
    assert [r[0] for r in n.select(X.to_int(F.col("s"), -1)).collect()] == [3, -1, -1]


def test_streak(spark):
    v = [1, 2, -1, 3, 4, 5, -1, 1]
    df = spark.createDataFrame([("A", dt.date(2024, 1, 1 + i), float(x), i + 1) for i, x in enumerate(v)], "asset string, d date, x double, t int")
    w = FL.series("asset")
    got = df.select("d", FL.positive_streak(F.col("x"), w, F.col("t")).alias("s")).orderBy("d").collect()
    assert [r.s for r in got] == [1, 2, 0, 1, 2, 3, 0, 1]


@pytest.mark.parametrize("block", [96, 300, None])
def test_ewm_blocks(spark, block):
    rng = np.random.default_rng(1)
    x = rng.normal(5, 2, 400)
    df = spark.createDataFrame([("A", i, float(v)) for i, v in enumerate(x)], "asset string, t int, x double")
    got = add_ewm(df, "asset", "t", {"y": ("x", 3)}, block).orderBy("t").toPandas()["y"]
    want = pd.Series(x).ewm(alpha=1 / 3, adjust=False).mean()
    assert np.allclose(got, want, rtol=1e-12)


def test_ewm_refuses_blocks_that_forget(spark):
    df = spark.createDataFrame([("A", 0, 1.0)], "asset string, t int, x double")
    with pytest.raises(ValueError):
        add_ewm(df, "asset", "t", {"y": ("x", 3)}, 7)


def test_technical_against_pandas(spark):
    pdf = bars_of(5, 320)
    got = T.technical_features(spark.createDataFrame(pdf)).toPandas().sort_values(["asset", "d"])
    for a, g in pdf.groupby("asset"):
        r = got[got.asset == a].reset_index(drop=True)
        c = g.close.reset_index(drop=True)
        assert np.allclose(r["ma_200"].astype(float), c.rolling(200).mean(), equal_nan=True)
        assert np.allclose(r["bb_upper_20"].astype(float), c.rolling(20).mean() + 2 * c.rolling(20).std(), equal_nan=True)
        chg = c.diff()
        ag, al = (s.ewm(alpha=1 / 14, adjust=False).mean() for s in (chg.clip(lower=0).fillna(0), (-chg).clip(lower=0).fillna(0)))
        rsi = (100 - 100 / (1 + ag / al)).where(np.arange(len(c)) >= 14)
        assert np.allclose(r["rsi_14"].astype(float), rsi, equal_nan=True)


def test_asof_and_pit(spark):
    pdf = bars_of(2, 60)
    bars = spark.createDataFrame(pdf)
    keys = spark.createDataFrame([("A", dt.date(2019, 12, 1)), ("A", dt.date(2020, 1, 4)), ("B", dt.date(2020, 2, 2)), ("C", dt.date(2020, 2, 2))], "asset string, rd date")
    got = {(r.asset, r.rd): (r.close, r.seen) for r in A.asof(keys, bars, ["asset"], "rd", "d", ["close"], seen="seen").collect()}
    assert got[("A", dt.date(2019, 12, 1))] == (None, None) and got[("C", dt.date(2020, 2, 2))] == (None, None)
    for (a, rd), (c, seen) in got.items():
        past = pdf[(pdf.asset == a) & (pdf.d <= rd)]
        if len(past):
            assert (c, seen) == (past.close.iloc[-1], past.d.iloc[-1])


def test_future_rows_do_not_change_the_past(spark):
    """Everything known at rd is the same when the rows after rd are deleted."""
    pdf = bars_of(9, 300)
    cut = pdf.d.sort_values().iloc[400]
    keys = spark.createDataFrame([("A", cut), ("B", cut)], "asset string, rd date")
    full = T.technical_at(spark.createDataFrame(pdf), None, keys).toPandas()
    past = T.technical_at(spark.createDataFrame(pdf[pdf.d <= cut]), None, keys).toPandas()
    pd.testing.assert_frame_equal(full.sort_values("asset", ignore_index=True), past.sort_values("asset", ignore_index=True))


def test_row_order_does_not_matter(spark):
    pdf = bars_of(4, 200)
    a = EP.dip_candidates(spark.createDataFrame(pdf), dip_1d=-0.03).toPandas()
    b = EP.dip_candidates(spark.createDataFrame(pdf.sample(frac=1, random_state=1)).repartition(7), dip_1d=-0.03).toPandas()
    key = ["asset", "dip_date"]
    pd.testing.assert_frame_equal(a.sort_values(key, ignore_index=True), b.sort_values(key, ignore_index=True))


def test_late_filing_is_invisible(spark):
    cols = "asset string, year int, reprt_code string, period_end date, rcept_dt date, revenue double, operating_income double, net_income double, total_assets double, total_equity double, total_liabilities double"
    rows = [("A", 2022, "11011", dt.date(2022, 12, 31), dt.date(2023, 3, 1), 100.0, 10.0, 5.0, 1.0, 1.0, 0.0), ("A", 2023, "11013", dt.date(2023, 3, 31), dt.date(2023, 5, 15), 30.0, 3.0, 1.0, 2.0, 1.0, 1.0), ("A", 2023, "11012", dt.date(2023, 6, 30), None, 70.0, 3.0, 1.0, 2.0, 1.0, 1.0)]
    keys = spark.createDataFrame([("A", dt.date(2023, 2, 1)), ("A", dt.date(2023, 5, 14)), ("A", dt.date(2023, 12, 1))], "asset string, rd date")
    got = [r.revenue_ttm for r in FU.ttm_features(spark.createDataFrame(rows, cols), keys).orderBy("rd").collect()]
    assert got == [None, 100.0, 120.0]


def test_unknown_listing_age_fails_closed(spark):
    df = spark.createDataFrame([("000010", "X", 1e10, 1e12, None), ("000010", "X", 1e10, 1e12, 40), ("000015", "X", 1e10, 1e12, 40), ("000010", "Y SPAC 3", 1e10, 1e12, 40)],
                               "asset string, name string, avg_trading_value_60d double, market_cap double, listed_months int")
    assert [r.exclude_reason for r in U.apply_eligibility(df).collect()] == ["too_new", "", "preferred", "spac"]


def test_weight_cap_tiers(spark):
    df = spark.createDataFrame([(0.3, 0.05), (0.45, 0.05), (0.65, 0.05), (0.85, 0.10)], "r double, w double")
    assert [x[0] for x in df.select(E.governance_weight_cap(F.col("r"), F.col("w"))).collect()] == [0.05, 0.04, 0.02, 0.0]


def test_event_windows_against_brute_force(spark):
    rng = np.random.default_rng(8)
    day0 = dt.date(2022, 1, 1)
    ev = pd.DataFrame({"asset": rng.choice(["A", "B"], 300, p=[0.8, 0.2]), "rcept_dt": [day0 + dt.timedelta(int(x)) for x in rng.integers(0, 700, 300)],
                       "event_category": rng.choice(["treasury_buyback", "bonus_issue", "insider_holdings"], 300), "aqpln_prc_ostk": rng.integers(1, 10**6, 300), "bsis_stkqy": rng.integers(0, 100, 300),
                       "aft_stkqy": rng.integers(0, 100, 300), "trade_uv": rng.integers(1, 50, 300)})
    ks = [(a, day0 + dt.timedelta(int(x)), 1e8) for a in "AB" for x in range(50, 700, 60)]
    got = E.event_scores(spark.createDataFrame(ev), spark.createDataFrame(ks, "asset string, rd date, market_cap double")).toPandas()
    for _, r in got.iterrows():
        w = ev[(ev.asset == r.asset) & (ev.rcept_dt <= r.rd) & (ev.rcept_dt >= r.rd - dt.timedelta(90))]
        buy = w[w.event_category == "treasury_buyback"].aqpln_prc_ostk.sum()
        assert abs(r.event_treasury_buyback_score - 0.5 * min(1, buy / 1e8 / 0.02)) < 1e-9
        i = w[w.event_category == "insider_holdings"]
        net = ((i.aft_stkqy - i.bsis_stkqy) * i.trade_uv).sum()
        assert abs(r.event_insider_holdings_score - 0.3 * max(-1, min(1, net / 1e8 / 0.005))) < 1e-9
        assert r.event_bonus_issue_score == (0.3 if (w.event_category == "bonus_issue").any() else 0.0)


def test_water_filling_against_iteration(spark):
    rng = np.random.default_rng(6)
    rows = []
    for g in range(6):
        w = rng.random(9) ** 3
        rows += [("s", f"g{g}", f"a{i}", float(x)) for i, x in enumerate(w / w.sum())]
    got = P.water_fill_cap(spark.createDataFrame(rows, "strategy string, rd string, asset string, weight double"), "weight", 0.2).toPandas()
    for _, g in got.groupby("rd"):
        w = g.weight.to_numpy(copy=True)
        for _ in range(200):
            over = w > 0.2 + 1e-15
            if not over.any():
                break
            slack = (w[over] - 0.2).sum()
            w[over] = 0.2
            free = w < 0.2
            w[free] += slack * w[free] / w[free].sum()
        assert np.allclose(g.capped_weight, w) and abs(g.capped_weight.sum() - 1) < 1e-9


def test_multibagger_against_brute_force(spark):
    rng = np.random.default_rng(12)
    rows, want = [], []
    for a in ("A", "B", "C"):
        p = np.round(100 * np.exp(np.cumsum(rng.normal(0.01, 0.15, 60))), 2)
        d = [x.date() for x in pd.date_range("2018-01-31", periods=60, freq="ME")]
        rows += [(a, x, float(y)) for x, y in zip(d, p)]
        last = None
        for i in range(60):
            f = p[i + 1: i + 25]
            if len(f) and f.max() / p[i] - 1 >= 0.8 and (last is None or d[i] > last):
                j = i + 1 + int(np.argmax(f))
                want.append((a, d[i], d[j]))
                last = d[j]
    got = EP.multibagger_episodes(spark.createDataFrame(rows, "asset string, rd date, close double"), 0.8)
    assert sorted((r.asset, r.entry_date, r.peak_date) for r in got.collect()) == sorted(want)


def test_label_windows_are_half_open(spark):
    ep = spark.createDataFrame([("A", dt.date(2024, 8, 31))], "asset string, surge_start_date date")
    panel = spark.createDataFrame([("A", x.date()) for x in pd.date_range("2024-01-31", periods=12, freq="ME")], "asset string, rd date")
    got = {r.rd.month: (r.is_pre_surge, r.is_pre_entry, r.is_continuation) for r in LB.label_windows(panel, ep).collect()}
    assert got[2] == (1, 1, 0) and got[7] == (1, 0, 0) and got[8] == (1, 0, 1) and got[11] == (1, 0, 1) and got[12] == (0, 0, 0) and got[1] == (0, 0, 0)
    assert all(not (b and c) for _, b, c in got.values())


def test_embargo_gap(spark):
    days = [(x.date(),) for x in pd.date_range("2018-01-31", periods=60, freq="ME")]
    panel = spark.createDataFrame([(d[0], i) for d in days for i in range(50)], "rd date, i int")
    f = LB.purged_splits(panel, 5, 9).toPandas()
    order = {d[0]: i for i, d in enumerate(days)}
    for _, g in f.groupby("fold"):
        tr, te = ([order[x] for x in g[g.role == r].rd] for r in ("train", "test"))
        assert min(te) - max(tr) > 9
    few = LB.purged_splits(panel.filter(F.col("rd") < "2018-11-01"), 5, 9)
    assert few.count() > 0 and few.filter("usable").count() == 0


def test_identifiers_are_never_cut(spark):
    got = spark.createDataFrame([(1,), (123456,), (1234567,), (1234568,)], "k long").select(asset_id(F.col("k")), X.padded(F.col("k"), 8)).collect()
    assert [tuple(r) for r in got] == [("000001", "00000001"), ("123456", "00123456"), ("1234567", "01234567"), ("1234568", "01234568")]


def test_event_amounts_keep_fractions_and_texts(spark):
    d = dt.date(2022, 1, 3)
    rows = [("A", d, "major_holders", "0.29", None, None, None, None), ("A", d, "major_holders", "0.02", None, None, None, None), ("B", d, "treasury_buyback", None, "1,234", None, None, None),
            ("C", d, "treasury_buyback", None, "none", None, None, None), ("D", d, "insider_holdings", None, None, "10", "12.5", "2.25"), ("E", d, "insider_holdings", None, None, None, "4", "3")]
    ev = spark.createDataFrame(rows, "asset string, rcept_dt date, event_category string, stkrt_irds string, aqpln_prc_ostk string, bsis_stkqy string, aft_stkqy string, trade_uv string")
    got = {r.asset: r for r in E.event_scores(ev, spark.createDataFrame([(a, d, 100_000.0) for a in "ABCDE"], "asset string, rd date, market_cap double")).collect()}
    assert abs(got["A"].event_major_holders_score - 0.25 * 0.31) < 1e-12
    assert abs(got["B"].event_treasury_buyback_score - 0.5 * 0.617) < 1e-12 and got["C"].event_treasury_buyback_score == 0
    assert abs(got["D"].event_insider_holdings_score - 0.3 * 5.625 / 500) < 1e-12 and abs(got["E"].event_insider_holdings_score - 0.3 * 12 / 500) < 1e-12
    amounts = spark.createDataFrame([("A", d, "insider_holdings", 5, 3, 40)], "asset string, rcept_dt date, event_category string, bsis_stkqy int, aft_stkqy int, trade_amt int")
    one = E.event_scores(amounts, spark.createDataFrame([("A", d, 100_000.0)], "asset string, rd date, market_cap double")).first()
    assert abs(one.event_insider_holdings_score + 0.3 * 40 / 500) < 1e-12


def test_stage_without_history_is_transition(spark):
    names = ["rs_kospi_20d", "rs_kospi_60d", "rs_kospi_20d_zscore_60d", "abs_return_20d", "abs_return_60d", "abs_return_120d"]
    rows = [(None,) * 6, (0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (0.1, None, None, 0.1, None, None)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    assert [r[0] for r in df.select(TH.lifecycle_stage()).collect()] == ["transition", "accumulate", "markup"]


def test_regime_order(spark):
    base = {c: d for c, d in RG.DEFAULTS.items()}
    rows = [dict(base, kospi_above_ma200=True, market_foreign_cumulative_60d=1.0, macro_kr_pmi=49.0), dict(base, kospi_above_ma200=False, vkospi_level=26.0), dict(base, kospi_above_ma200=True, vkospi_level=21.0, market_foreign_net_buy_20d_kospi=-1.0),
            dict(base, kospi_above_ma200=True, macro_usd_krw=1500.0, market_foreign_cumulative_60d=-2e13, kospi_5d_return=-0.2)]
    df = spark.createDataFrame(pd.DataFrame(rows))
    assert [r[0] for r in df.select(RG.classify_regime()).collect()] == ["recovery", "bear_falling", "bull_peaking", "won_crisis"]


def test_disabled_groups_keep_their_schema(spark):
    df = spark.createDataFrame([("A",)], "asset string")
    for g, cols in GROUPS.items():
        out = with_feature_group(df, g, enabled=False)
        assert set(cols) <= set(out.columns)
        again = with_feature_group(out, g, enabled=True)
        assert again.columns == out.columns


def test_assert_complete_raises(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    with pytest.raises(Exception, match="incomplete value"):
        H.assert_complete(df, ["x"]).collect()
    with pytest.raises(ValueError):
        H.assert_complete(df.withColumn("b", F.lit(True)), ["b"])


@pytest.mark.parametrize("files", [None, 1])
def test_dip_stream_across_batches(spark, tmp_path, files):
    """Bars and flows in any order and any number of batches give the verdicts that all of them at once give."""
    pdf = bars_of(21, 80, ("A", "B", "C"))
    rng = np.random.default_rng(4)
    pdf["foreign_net"], pdf["inst_net"] = rng.normal(0, 4e8, len(pdf)).round(), rng.normal(0, 4e8, len(pdf)).round()
    pdf.loc[pdf.index % 7 == 3, ["foreign_net", "inst_net"]] = np.nan
    pdf["part"] = rng.permutation(len(pdf)) % 3 if files else 0
    late = pdf[(pdf.asset == "A") & (pdf.index % 80 >= 30) & (pdf.index % 80 < 35)].index
    pdf["part"] = pdf["part"].where(pdf.asset == "C", (pdf.index % 80) // 20)
    pdf.loc[late, "part"] = 4
    schema = "asset string, d date, close double, low double, high double, foreign_net double, inst_net double"
    cols = [c.split()[0] for c in schema.split(", ")]
    rows = lambda g: spark.createDataFrame([tuple(None if v != v else v for v in r) for r in g[cols].itertuples(index=False)], schema)
    src = tmp_path / "days"
    for k in sorted(pdf.part.unique()):
        rows(pdf[pdf.part == k]).coalesce(1).write.mode("append").parquet(str(src))
    mcap = spark.createDataFrame([(a, dt.date(2019, 12, 31), 3e11) for a in "AC"] + [("A", dt.date(2020, 3, 1), 9e11)], "asset string, snapshot_date date, market_cap double")
    held = spark.createDataFrame([("A",), ("C",)], "asset string")
    out = ["asset", "d", "dip_1d_pct", "dip_5d_pct", "foreign_net_5d", "inst_net_5d", "flow_threshold", "verdict", "confidence", "severity"]
    got = MO.dip_alert_stream(MO.stream_of(spark, str(src), schema, files), mcap, held).select(*out).collect()
    whole = rows(pdf)
    flow = whole.filter("foreign_net is not null").withColumn("individual_net", F.lit(0.0))
    want = MO.dip_alerts(whole, flow, mcap, held).select(*out).collect()
    plain = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    assert len(want) > 5 and len({r.verdict for r in want}) == 3
    assert sorted(map(plain, got), key=str) == sorted(map(plain, want), key=str)


@pytest.mark.parametrize("files", [None, 1])
def test_event_stream_loses_nothing(spark, tmp_path, files):
    d0, src = dt.date(2022, 1, 1), str(tmp_path / "events")
    rows = [(f"A{k % 3}", f"r{k}", d0 + dt.timedelta(40 * k), "spinoff", dt.datetime(2022, 1, 1) + dt.timedelta(40 * k)) for k in range(12)]
    schema = "asset string, rcept_no string, rcept_dt date, event_category string, ts timestamp"
    for part in (rows[8:], rows[:4], rows[4:9]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    held = spark.createDataFrame([("A0",), ("A1",), ("A2",)], "asset string")
    out = MO.run_available(MO.event_alert_stream(MO.stream_of(spark, src, spark.read.parquet(src).schema, files), held), "events")
    assert sorted(r.rcept_no for r in out.collect()) == sorted(r[1] for r in rows)


@pytest.mark.parametrize("files", [None, 1])
def test_tick_bars_of_a_table_that_is_a_folder(spark, tmp_path, files):
    t0 = dt.datetime(2022, 1, 3)
    rows = [(f"A{k % 2}", t0 + dt.timedelta(hours=7 * ((k * 5) % 24)), float(k), k) for k in range(24)]
    ticks = spark.createDataFrame(rows, "asset string, ts timestamp, price double, event_id int")
    ticks.repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    stream = MO.stream_of(spark, f"{tmp_path}/events.parquet*", ticks.schema, files)
    got = MO.run_versions(MO.bars_from_ticks(stream), "bars", ["asset", "start", "end"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, MO.bars_from_ticks(ticks).collect()))


def test_sessions_split_at_the_gap(spark):
    t0 = dt.datetime(2022, 1, 3, 9, 59, 50)
    at = [0, 5, 1804, 1804 + 1800, 9000, 9001]
    ticks = spark.createDataFrame([("A", t0 + dt.timedelta(seconds=s), 1.0) for s in at], "asset string, ts timestamp, price double")
    got = [(r.start, r.ticks) for r in MO.sessions(ticks).orderBy("start").collect()]
    assert got == [(t0, 3), (t0 + dt.timedelta(seconds=3604), 1), (t0 + dt.timedelta(seconds=9000), 2)]


def test_window_counts_equal_filtered_pairs(spark):
    rng = np.random.default_rng(12)
    day0 = dt.date(2022, 1, 1)
    events = [(str(a), None if d > 690 else day0 + dt.timedelta(int(d))) for a, d in zip(rng.choice(["A", "B"], 200, p=[0.9, 0.1]), rng.integers(0, 700, 200))]
    keys = [(a, day0 + dt.timedelta(k)) for a in "ABC" for k in range(0, 700, 45)]
    e, k = spark.createDataFrame(events, "asset string, d date"), spark.createDataFrame(keys, "asset string, rd date")
    got = H.window_counts(e, k, "d", {"m": F.add_months("rd", -3), "n": F.date_sub("rd", 91), "all": None}).collect()
    j = k.join(e, "asset", "left")
    want = j.groupBy("asset", "rd").agg(
        F.count_if(H.in_lookback_months(F.col("d"), F.col("rd"), 3)), F.count_if(H.in_lookback_days(F.col("d"), F.col("rd"), 90)), F.count_if(F.col("d") <= F.col("rd"))).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


FILING = "asset string, year int, reprt_code string, period_end date, rcept_dt date, revenue double, operating_income double, net_income double, total_assets double, total_equity double, total_liabilities double"


def filing(asset, year, code, end, received, revenue, income=5.0):
    return (asset, year, code, dt.date.fromisoformat(end), dt.date.fromisoformat(received), revenue, income, income, 10 * revenue if revenue else None, 4.0, 6.0)


def test_growth_uses_what_was_known_then(spark):
    """The year before is amended after the current filing; a second asset files the year before late; a third amends the current year."""
    panel = spark.createDataFrame([
        filing("A", 2022, "11013", "2022-03-31", "2022-05-15", 100.0), filing("A", 2023, "11013", "2023-03-31", "2023-05-15", 150.0),
        filing("A", 2022, "11013", "2022-03-31", "2023-08-01", 120.0),
        filing("B", 2023, "11013", "2023-03-31", "2023-05-15", 30.0), filing("B", 2022, "11013", "2022-03-31", "2023-09-01", 20.0),
        filing("C", 2022, "11013", "2022-03-31", "2022-05-15", 10.0), filing("C", 2023, "11013", "2023-03-31", "2023-05-15", 20.0),
        filing("C", 2023, "11013", "2023-03-31", "2023-07-01", None), filing("C", 2023, "11013", "2023-03-31", "2023-10-01", 40.0),
        filing("D", 2023, "11013", "2023-03-31", "2023-05-15", 1.0), filing("D", 2022, "11013", "2022-03-31", "2022-05-15", 0.0005),
    ], FILING)
    days = [dt.date.fromisoformat(d) for d in ("2022-04-30", "2022-06-30", "2023-05-31", "2023-07-31", "2023-08-31", "2023-09-30", "2023-12-31")]
    keys = spark.createDataFrame([(a, d) for a in "ABCD" for d in days], "asset string, rd date")
    out = {(r.asset, r.rd): r for r in FU.ttm_features(panel, keys).collect()}
    growth = {a: [None if (g := out[a, d].revenue_growth_yoy) is None else round(g, 9) for d in days] for a in "ABCD"}
    assert growth == {
        "A": [None, None, 0.5, 0.5, 0.25, 0.25, 0.25], "B": [None, None, None, None, None, 0.5, 0.5],
        "C": [None, None, 1.0, None, None, None, 3.0], "D": [None] * 7,
    }
    assert [out["C", d].revenue_ttm for d in days] == [None, 40.0, 80.0, 80.0, 80.0, 80.0, 160.0]
    assert [out["C", d].total_assets for d in days] == [None, 100.0, 200.0, None, None, None, 400.0]
    assert out["A", days[-1]].fundamentals_rcept_dt == dt.date(2023, 5, 15) and out["C", days[-1]].fundamentals_rcept_dt == dt.date(2023, 10, 1)


def test_growth_shuffles_filings_once(spark):
    panel = spark.createDataFrame([filing("A", 2022, "11013", "2022-03-31", "2022-05-15", 100.0)], FILING)
    plan = FU.filing_states(panel)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange") == 1


@pytest.mark.parametrize("block", [1, 7, 64])
def test_rows_around_keys(spark, block):
    rng = np.random.default_rng(2)
    rows = [(a, int(p), float(p) * 2) for a in "AB" for p in sorted(rng.choice(np.arange(-90, 400), 200, replace=False))]
    keys = [(a, int(k), f"{a}{k}") for a in "ABC" for k in (-95, -3, 0, 63, 64, 200, 399, 900)]
    got = around(spark.createDataFrame(keys, "asset string, p long, name string"), spark.createDataFrame(rows, "asset string, p long, x double"), "asset", "p", -70, 5, ["x"], block)
    want = sorted((a, k, n, p - k, x) for a, k, n in keys for b, p, x in rows if a == b and -70 <= p - k <= 5)
    assert got.columns == ["asset", "p", "name", "o", "_x"] and sorted(map(tuple, got.collect())) == want


def test_bar_features_against_pandas(spark):
    pdf = bars_of(5, 330)
    pdf["close"] = pdf["close"].mask(pdf.index % 40 == 7, 100.0)
    dips = [("A", 10), ("A", 15), ("A", 47), ("A", 61), ("A", 260), ("A", 329), ("B", 31), ("B", 130)]
    per = {a: g.reset_index(drop=True) for a, g in pdf.groupby("asset")}
    eps = spark.createDataFrame([(a, per[a].d[t]) for a, t in dips] + [("A", dt.date(1999, 1, 1)), ("Z", per["A"].d[3])], "asset string, dip_date date")
    got = {(r.asset, r.t): r for r in D.bar_features(spark.createDataFrame(pdf), eps).collect()}
    assert sorted(got) == sorted(dips)
    for a, t in dips:
        g, r = per[a], got[a, t]
        c, v = g.close, g.volume
        past = c[max(0, t - 60):t].to_numpy()
        near = sum(abs(past[i] / past[max(0, i - 19):i + 1].mean() - 1) < 0.03 for i in range(9, len(past)))
        assert r.f_pre_dip_consolidation_days == (near if t >= 60 else None)
        assert (r.f_dist_from_52w_high is None) == (t < 252) and (r.f_dist_from_200_ma is None) == (t < 200)
        if t >= 252:
            assert np.isclose(r.f_dist_from_52w_high, c[t] / c[t - 252:t + 1].max() - 1)
        if t >= 60:
            assert np.isclose(r.f_vol_dip_day_z60, (v[t] - v[t - 60:t].mean()) / v[t - 60:t].std())
            assert np.isclose(r.f_vol_5d_avg_vs_60d, v[t - 5:t].mean() / v[t - 60:t].mean())
        if t >= 30:
            assert r.f_dip_duration_days == t - c[t - 30:t + 1].idxmax()
            assert np.isclose(r.f_vol_dryup_pct_pre_dip, (v[t - 30:t] < 0.7 * v[t - 30:t].mean()).mean())
            ov = np.sign(c.diff()) * v
            assert np.isclose(r.f_obv_slope_30d, ov[t - 28:t + 1].sum() / max(1, abs(ov[t - 29]) + 1e-9))
        assert (r.f_vol_post_dip_5d_vs_dip_day is None) == (t == 329)
        if t < 329:
            assert np.isclose(r.f_vol_post_dip_5d_vs_dip_day, v[t + 1:t + 6].mean() / v[t])


def test_outer_align_shuffles_once(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None)], "d int, x double")
    b = spark.createDataFrame([(2, "b"), (3, "c")], "d int, y string")
    c = spark.createDataFrame([(1, 5), (4, 6)], "d int, z int")
    out = A.outer_align([a, b, c])
    assert sorted(map(tuple, out.collect())) == [(1, 1.0, None, 5), (2, None, "b", None), (3, None, "c", None), (4, None, None, 6)]
    assert out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange") == 1


def test_landed_tables_follow_their_input(spark, tmp_path):
    days = lambda n, at: spark.createDataFrame([(at + k, k % 3, "A", "O", dt.date(2020, 1, 1 + at + k), 0.05, 0.02, 10.0, 100.0) for k in range(n)],
        "l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string, l_shipdate date, l_discount double, l_tax double, l_quantity double, l_extendedprice double")
    spark.createDataFrame([(k, 100.0) for k in range(20)], "p_partkey long, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    days(6, 0).write.parquet(f"{tmp_path}/lineitem.parquet")
    star = Star(spark, str(tmp_path))
    assert star.bars().count() == 6 and star.flow().count() == 6
    days(4, 6).write.mode("append").parquet(f"{tmp_path}/lineitem.parquet")
    assert star.bars().count() == 10 and Star(spark, str(tmp_path)).flow().count() == 10


def test_cluster_summary_lists_themes_and_leaves_noise_out(spark):
    assets = spark.createDataFrame([("a", 1, 0.5, 0.1, 10.0), ("b", 1, 0.7, None, 30.0), ("c", 1, None, 0.3, None), ("d", 2, 0.1, 0.1, 5.0), ("e", None, 9.0, 9.0, 9.0)],
                                   "asset string, cluster int, return_60d double, return_20d double, mcap double")
    themes = spark.createDataFrame([("T1", "a"), ("T2", "a"), ("T2", "b"), ("T2", "b"), ("T1", "c"), ("T0", "e")], "theme string, asset string")
    out = {r.cluster: r for r in EV.cluster_summary(assets, themes, top=2).collect()}
    assert sorted(out) == [1, 2]
    assert (out[1].n_members, out[1].primary_theme, out[1].themes, out[1].leaders, out[1].median_mcap) == (3, "T1", "T1:2,T2:2", "b,a", 20.0)
    assert (out[2].primary_theme, out[2].themes) == ("unnamed", None)


def test_far_members_of_a_cluster_are_noise(spark):
    rng = np.random.default_rng(3)
    rows = [(f"a{k}", [float(v) for v in rng.normal(0 if k < 40 else 50, 1, 4)]) for k in range(80)] + [("far", [30.0, 0.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "asset string, x array<double>").select("asset", array_to_vector("x").alias("x"))
    out = {r.asset: r.cluster for r in M.discover_clusters(v, 2, noise=3.0).collect()}
    assert out["far"] is None and len({out[f"a{k}"] for k in range(40)}) == 1 and len({out[f"a{k}"] for k in range(80)}) == 2
    assert {r.cluster for r in M.discover_clusters(v, 2).collect()} == {0, 1}


def test_published_models_are_read_back_or_refused(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(f"a{k}", int(k % 2), float(k % 2 + rng.normal(0, 0.3)), float(rng.normal()), None) for k in range(200)]
    dips = spark.createDataFrame(rows, "asset string, label int, f_x double, f_y double, f_empty double")
    store = M.ModelStore(spark, str(tmp_path / "store"))
    with pytest.raises(ValueError, match="no published model"):
        M.scored_dips(dips, store)
    assert M.dip_model_job(dips, ["f_x", "f_y", "f_empty"], store, trees=3) == 1
    assert M.dip_model_job(dips.filter("label is not null"), ["f_x"], store, "2", trees=3) == 2
    assert [(r.version, r.engine_version, list(r.feature_cols), r.n_rows, r.n_positive) for r in store.versions().orderBy("version").collect()] == [(1, "1", ["f_x", "f_y"], 200, 100), (2, "2", ["f_x"], 200, 100)]
    got = M.scored_dips(dips.withColumn("label", F.lit(None).cast("int")), store, version=1).collect()
    side = {int(r.asset[1:]) % 2: [] for r in got}
    for r in got:
        side[int(r.asset[1:]) % 2].append(r.p)
    assert np.mean(side[1]) > 0.8 and np.mean(side[0]) < 0.2
    with pytest.raises(ValueError, match="made by engine 2"):
        M.scored_dips(dips, store)
    with pytest.raises(ValueError, match="lacks: .'f_x'"):
        M.scored_dips(dips.drop("f_x"), store, "2")
    with pytest.raises(ValueError, match="no dip has a label"):
        M.dip_model_job(dips.filter("label > 1"), ["f_x"], store)
    assert M.dip_model_job(dips.filter("label = 1"), ["f_x"], store) == 3
    assert {r.p for r in M.scored_dips(dips, store).collect()} == {1.0}


def test_packets_from_files(spark, tmp_path):
    good = '{"packet_id": "p1", "schema": "moat-quality-v2", "extra": {"a": 1}, "dimensions": {"pricing_power": {"assessment": 0.4, "mood": 1, "evidence": [{"evidence_id": "e"}]}}}'
    lines = [good, '{"packet_id": "p2", "dimensions": {"pricing_power": {"assessment": "much"}}}', '{"packet_id": "p3", "dim', "[1, 2]", "7", '{"schema": "x"}', '{"packet_id": " "}', "", "  "]
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.json").write_text("\n".join(lines))
    got = PF.read_packets(spark, str(tmp_path / "lines"), "moat")
    ok = {r.packet_id: r for r in PF.judged(got).collect()}
    assert sorted(ok) == ["p1", "p2"] and ok["p1"].unknown_fields == ["extra", "pricing_power.mood"] and ok["p2"].unknown_fields == []
    assert ok["p1"].dimensions["pricing_power"].assessment == 0.4 and ok["p2"].dimensions["pricing_power"].assessment is None
    assert sorted((r.reason, r.raw) for r in PF.quarantine(got).collect()) == sorted([("not_json", lines[2]), ("packet_object", "[1, 2]"), ("packet_object", "7"), ("packet_id", lines[5]), ("packet_id", lines[6])])
    for k, text in enumerate(["{\n" + good[1:], good[:40]]):
        (tmp_path / f"whole{k}.json").write_text(text)
    whole = PF.read_packets(spark, f"{tmp_path}/whole*.json", "moat", whole_files=True)
    assert sorted((r.packet_id or "", r.reason or "") for r in whole.collect()) == [("", "not_json"), ("p1", "")]
    codes = {(r.packet_id, r.code) for r in PK.moat_violations(PF.judged(got), "2030-01-01T00:00:00Z").collect()}
    assert {("p2", "assessment:pricing_power"), ("p2", "evidence_required:pricing_power"), ("p1", "dimension_set"), ("p1", "evidence_direction")} <= codes


def test_every_rule_has_a_fault(spark):
    plain = lambda table: {c.split(":")[0] for codes in table.values() for c in codes}
    assert len(plain(PX.MOAT)) == 42 and len(plain(PX.METHODOLOGY)) == 39
    assert max(len(PX.MOAT), len(PX.METHODOLOGY)) < PX.SLOTS


def test_packet_files_are_compressed_and_parsed_in_place(spark, tmp_path, monkeypatch):
    from panelspark.catalog import packets as C

    rows = spark.range(130).select((F.col("id") + 1).alias("o_orderkey"), F.lit(7).cast("bigint").alias("o_custkey"), F.lit("1996-01-02").cast("date").alias("o_orderdate"))
    rows.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(C, "scratch", lambda spark, name: str(tmp_path / name))
    s = Star(spark, str(tmp_path))
    lines = PX.moat_lines(s)
    got = C._packet_files(s, lines, "moat")
    files = got.inputFiles()
    assert files and all("moat-packets" in f and f.endswith(".gz") for f in files)
    assert got.count() == 130
    written = sum(p.stat().st_size for p in (tmp_path / "moat-packets").glob("*.gz"))
    assert written * 4 < lines.agg(F.sum(F.length("value"))).first()[0]


def test_risk_on_the_edge_of_a_tier(spark):
    """A physical spin-off counts 0.2 x 0.7 = 0.14; the product of the two doubles is less."""
    day = dt.date(2020, 1, 10)
    events = spark.createDataFrame([("A", day, "spinoff", "물적분할", None)], "asset string, rcept_dt date, event_category string, div_mth string, dppln_prc_ostk long")
    uni = spark.createDataFrame([("A", dt.date(2020, 1, 31), 1e9, False)], "asset string, rd date, market_cap double, group_flag boolean")
    assert E.governance_scores(events, uni).first().governance_risk_score == 0.14


def test_receipt_numbers_of_more_digits(spark):
    df = spark.createDataFrame([("19950102000007",), ("199501021234567",), ("1995010212345",), ("1995010200000x",), ("19951302000007",)], "s string")
    assert [r[0] for r in df.select(X.receipt_date(F.col("s"))).collect()] == [dt.date(1995, 1, 2), dt.date(1995, 1, 2), None, None, None]


def test_yield_alone_is_no_valuation(spark):
    keys = spark.createDataFrame([("A", 1), ("B", 1), ("C", 1)], "asset string, rd int")
    v = spark.createDataFrame([("A", 1, None, None, 0.0), ("B", 1, None, 2.0, 0.0)], "asset string, rd int, per double, pbr double, dividend_yield double")
    got = {r.asset: (r.pbr, r.dividend_yield) for r in FU.valuation_snapshot(keys, v).collect()}
    assert got == {"A": (None, None), "B": (2.0, 0.0), "C": (None, None)}


def test_features_of_every_bar_equal_those_at_dips(spark):
    pdf = bars_of(7, 300)
    pdf["close"] = pdf["close"].mask(pdf.index % 40 == 7, 100.0)
    bars = spark.createDataFrame(pdf)
    at = {(r.asset, r.d): r for r in D.bar_features(bars, bars.select("asset", F.col("d").alias("dip_date"))).collect()}
    for every, names in [(D.price_features(bars), D.PRICE), (D.volume_features(bars), D.VOLUME)]:
        rows = every.collect()
        assert len(rows) == len(at) == 600
        for r in rows:
            for n in names:
                x, y = r[n], at[r.asset, r.d][n]
                assert (x is None) == (y is None) and (x is None or np.isclose(x, y, rtol=1e-6, atol=1e-6)), (n, r)


def test_dip_panel_is_built_once_for_a_state_of_the_input(spark, tmp_path, monkeypatch):
    from types import SimpleNamespace

    from panelspark.catalog import load

    load()
    from panelspark.catalog import episodes as C

    class Tables(Star):
        bars = flow = market = disclosures = lambda self: None

    for t in ("lineitem", "part", "orders", "supplier"):
        spark.range(1).write.parquet(str(tmp_path / f"{t}.parquet"))
    built = []
    monkeypatch.setattr(C, "D", SimpleNamespace(dip_feature_panel=lambda *a: built.append(1) or spark.range(3)))
    monkeypatch.setattr(C, "T", SimpleNamespace(realized_vol=lambda m: None))
    for name in ("dips", "_risk"):
        monkeypatch.setattr(C, name, lambda s: None)
    assert [C.dip_panel(Tables(spark, str(tmp_path))).count() for _ in range(2)] == [3, 3] and len(built) == 1
    spark.range(5).write.mode("append").parquet(str(tmp_path / "orders.parquet"))
    assert C.dip_panel(Tables(spark, str(tmp_path))).count() == 3 and len(built) == 2
