"""Time the headline queries and print one JSON line.

BENCH_SF_DIR  data folder (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
Each query runs to a no-op sink, so every row of its result is computed. The
session is warmed by one small query of another table; then the landing of line items by supplier and
day, which the other queries read, is timed as a line of its own, and every query once, cold plan included.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from panelspark.catalog import load  # noqa: E402
from panelspark.sources.star import Star  # noqa: E402

HEADLINE = [
    "table_bars", "asof_close", "universe_snapshot", "technical_features", "trend_template", "rsi_wilder", "momentum_features",
    "percentile_rank", "robust_z", "topn_per_date", "ticker_flow_signals", "classify_regime", "fundamental_features", "event_scores",
    "governance_scores", "topn_backtest", "portfolio_metrics", "variant_matrix", "multibagger_episodes", "label_windows", "dip_episodes",
    "dip_feature_panel", "theme_strength", "theme_leaders", "moat_violations", "monthly_picks", "bars_from_ticks", "sessions",
]


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("panelspark-bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(int(cpus) * 2))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="panelspark-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry = load()
    only = sys.argv[1:]
    spark.read.parquet(f"{path}/nation.parquet").groupBy("n_regionkey").count().write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    t0 = time.time()
    Star(spark, path).calendar()
    times["landing"] = round(time.time() - t0, 3)
    print(f"landing: {times['landing']}s", file=sys.stderr, flush=True)
    for name in HEADLINE:
        if only and name not in only:
            continue
        t0 = time.time()
        registry[name].run(spark, path).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": path.rstrip("/").split("/sf")[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
