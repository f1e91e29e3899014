"""Cross-sectional ranks, robust z-scores and calendar momentum."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from panelspark.functions.scalars import clip
from panelspark.operators import ordered
from panelspark.operators.asof import asof
from panelspark.sources.files import materialize


def rank_in_date(df: DataFrame, score: str, k: int | None, keys: list[str] | None = None, out: str = "rank", tie: str = "asset") -> DataFrame:
    """Rank 1..k by score descending with an explicit tie-break.

    With a limit Spark keeps only k rows per key and input partition before the shuffle.
    """
    w = Window.partitionBy(*(keys or ["rd"])).orderBy(F.col(score).desc_nulls_last(), F.col(tie))
    ranked = df.withColumn(out, F.row_number().over(w))
    return ranked.filter(F.col(out) <= k) if k is not None else ranked


def percentile_ranks(df: DataFrame, keys: list[str], ids: list[str], cols: list[str], suffix: str = "_rank", null_fill: float | None = 0.5) -> DataFrame:
    """Average-tie rank / non-null count of several columns inside each group, all columns in one pass."""
    df = materialize(df, "ranks")
    long = ordered.unpivot(df, [*keys, *ids], cols).filter(F.col("_val").isNotNull())
    ranked = ordered.average_rank(long, [*keys, "_col"], "_val", "_rank")
    wide = ordered.repivot(ranked, [*keys, *ids], cols, "_rank", suffix)
    out = df.join(wide, [*keys, *ids], "left")
    if null_fill is not None:
        out = out.withColumns({f"{c}{suffix}": F.coalesce(F.col(f"{c}{suffix}"), F.lit(null_fill)) for c in cols})
    return out


def robust_z(df: DataFrame, keys: list[str], ids: list[str], cols: list[str], suffix: str = "_z") -> DataFrame:
    """Winsorise at 1/99 %, (x - median) / (1.4826 MAD), clipped to +-4.

    Fewer than five values give NULL; a vanishing MAD gives 0 to every row, missing ones included.
    """
    df = materialize(df, "zscores")
    long = ordered.unpivot(df, [*keys, *ids], cols)
    group = [*keys, "_col"]
    q = ordered.exact_quantiles(long, group, "_val", {"_q01": 0.01, "_med": 0.5, "_q99": 0.99})
    w = long.join(q, group).withColumn("_w", F.greatest(F.least("_val", "_q99"), "_q01"))
    w = w.withColumn("_w", F.when(F.col("_val").isNotNull(), F.col("_w"))).withColumn("_dev", F.abs(F.col("_w") - F.col("_med")))
    mad = ordered.exact_quantiles(w, group, "_dev", {"_mad": 0.5}).drop("n")
    z = F.when(F.col("n") >= 5, F.when(F.col("_mad") < 1e-12, F.lit(0.0)).otherwise(
        clip((F.col("_w") - F.col("_med")) / (F.lit(1.4826) * F.col("_mad")), -4, 4)))
    scored = w.join(mad, group, "left").withColumn("_z", z)
    return df.join(ordered.repivot(scored, [*keys, *ids], cols, "_z", suffix), [*keys, *ids], "left")


# Market-cap edges of the sector proxy.
MCAP_EDGES = [5e11, 2e12, 1e13]


def sector_proxy(df: DataFrame) -> DataFrame:
    """Sector where known, else exchange x market-cap bucket."""
    m = F.col("market_cap")
    bucket = F.when(m < MCAP_EDGES[0], "small").when(m < MCAP_EDGES[1], "mid").when(m < MCAP_EDGES[2], "large").otherwise("mega")
    proxy = F.concat_ws("_", "exchange" if "exchange" in df.columns else "market", F.when(m.isNull(), "unknown").otherwise(bucket))
    return df.withColumn("sector_key", F.coalesce("sector", proxy) if "sector" in df.columns else proxy)


def sector_neutral_ranks(df: DataFrame, cols: list[str]) -> DataFrame:
    keyed = df if "sector_key" in df.columns else sector_proxy(df)
    return percentile_ranks(keyed, ["rd", "sector_key"], ["asset"], cols, "_sector_rank", None)


# Fixed values: (column, months back, months skipped).
HORIZONS = [("ret_1m", 1, 0), ("ret_3m", 3, 0), ("ret_6m", 6, 0), ("ret_12m", 12, 0), ("ret_12_1m", 11, 1)]


def calendar_returns(bars: DataFrame, keys: DataFrame, by: str = "asset", horizons=HORIZONS) -> DataFrame:
    """close(as of rd - skip) / close(as of rd - skip - months) - 1 for all horizons.

    Every (asset, rd) is exploded to its distinct target dates; one as-of pass answers all of them and
    the regrouping stays inside the same hash partitioning on the asset.
    """
    offsets = sorted({o for _, m, s in horizons for o in (s, s + m)})
    targets = keys.select(by, "rd", F.explode(F.array(*[F.lit(o) for o in offsets])).alias("_o")).withColumn(
        "_t0", F.add_months("rd", -F.col("_o"))
    )
    got = asof(targets, bars, [by], "_t0", "d", ["close"])
    at = {o: F.max(F.when(F.col("_o") == o, F.col("close"))) for o in offsets}
    wide = got.groupBy(by, "rd").agg(*[c.alias(f"_c{o}") for o, c in at.items()])
    rets = [
        F.when(F.col(f"_c{s + m}") > 0, F.col(f"_c{s}") / F.col(f"_c{s + m}") - 1).alias(name) for name, m, s in horizons
    ]
    return wide.select(by, "rd", *rets)


def momentum_features(bars: DataFrame, index_bars: DataFrame, keys: DataFrame, fill: float | None = 0.0) -> DataFrame:
    """Nine momentum columns: five calendar returns and strength against two indexes over 3 and 12 months."""
    own = calendar_returns(bars, keys)
    idx = calendar_returns(
        index_bars.filter(F.col("index_id").isin("KOSPI", "KOSDAQ")),
        _index_dates(index_bars, keys), "index_id", [h for h in HORIZONS if h[0] in ("ret_3m", "ret_12m")],
    )
    wide = idx.groupBy("rd").agg(*[
        F.max(F.when(F.col("index_id") == i, F.col(c))).alias(f"_{i}_{c}") for i in ("KOSPI", "KOSDAQ") for c in ("ret_3m", "ret_12m")
    ])
    out = own.join(wide, "rd", "left")
    cols = {
        f"rs_{i.lower()}_{h}": F.col(f"ret_{h}") - F.col(f"_{i}_ret_{h}") for i in ("KOSPI", "KOSDAQ") for h in ("3m", "12m")
    }
    out = out.withColumns(cols).drop(*[c for c in wide.columns if c.startswith("_")])
    if fill is not None:
        out = out.fillna(fill, [c for c, _, _ in HORIZONS] + list(cols))
    return out


def _index_dates(index_bars: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.select("rd").distinct().select(F.explode(F.array(F.lit("KOSPI"), F.lit("KOSDAQ"))).alias("index_id"), "rd")


def momentum_score(df: DataFrame) -> DataFrame:
    """.5 z(12-1 month) + .3 z(6 month) + .2 z(strength over 12 months)."""
    from panelspark.functions.scalars import weighted_blend

    z = robust_z(df, ["rd"], ["asset"], ["ret_12_1m", "ret_6m", "rs_kospi_12m"])
    return z.withColumn("momentum_score", weighted_blend(z.columns, {"ret_12_1m_z": 0.5, "ret_6m_z": 0.3, "rs_kospi_12m_z": 0.2}))


def strict_session_returns(bars: DataFrame, index: DataFrame, key: str, horizons=(20, 60, 120, 240)) -> DataFrame:
    """Session-count returns on the index's own last sessions, log strength against the index.

    Returns (key, status, n_sessions, ret_h, rs_h); any gap in the grid rejects the key with a code.
    """
    need = max(horizons) + 1
    wi = Window.partitionBy(F.lit(1)).orderBy(F.col("d").desc())
    grid = index.select("d", F.col("close").alias("index_close"), (F.row_number().over(wi) - 1).alias("back")).filter(F.col("back") < need)
    on = bars.join(grid, "d")
    at = lambda c, h: F.max(F.when(F.col("back") == h, F.col(c)))
    agg = on.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_sessions"), F.min("back").alias("_latest"),
        *[at("close", h).alias(f"_a{h}") for h in (0, *horizons)], *[at("index_close", h).alias(f"_b{h}") for h in (0, *horizons)],
    )
    every = bars.select(key).distinct().join(agg, key, "left")
    status = F.when(F.coalesce("_latest", F.lit(-1)) != 0, "latest_session_missing").when(F.col("n_sessions") < need, "incomplete_window").otherwise("ok")
    ok = F.col("status") == "ok"
    out = every.withColumn("status", status)
    for h in horizons:
        ra, rb = F.col("_a0") / F.col(f"_a{h}") - 1, F.col("_b0") / F.col(f"_b{h}") - 1
        out = out.withColumn(f"ret_{h}", F.when(ok, ra)).withColumn(f"rs_{h}", F.when(ok, F.log1p(ra) - F.log1p(rb)))
    return out.select(key, "status", F.coalesce("n_sessions", F.lit(0)).alias("n_sessions"), *[f"{p}_{h}" for h in horizons for p in ("ret", "rs")])


