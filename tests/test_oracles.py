"""A spread of registered queries against their DuckDB text on the smallest tables, and contract checks for all of them."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from panelspark.catalog import load
from tools.check_oracles import TABLES, canon

SF = "/root/testdata/sf0.001"
CHECKED = [
    "table_bars", "table_flow", "table_fundamentals", "listing_history", "universe_snapshot", "asof_with_lag", "strict_violations", "first_available_source",
    "extract_accounts", "rsi_wilder", "bollinger", "weinstein_stage", "momentum_features", "percentile_rank", "robust_z", "ticker_flow_signals", "macro_snapshot_lagged",
    "ttm_features", "event_scores", "governance_scores", "water_fill_cap", "weight_turnover", "portfolio_metrics", "multibagger_episodes", "label_windows", "purged_splits",
    "dip_event_features", "theme_strength", "roc_auc", "dip_alerts", "sessions", "event_alert_stream", "moat_violations", "lens_scores",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_matches_duckdb(spark, con, name):
    e = load()[name]
    got, want = e.run(spark, SF).toPandas(), con.sql(e.sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


def test_every_sql_text_parses(con):
    for name, sql in entry.oracle_sql().items():
        con.sql(f"EXPLAIN {sql}")
        assert name in entry.queries()


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_entry_imports_without_the_corpus_package():
    """With the corpus package gone, whether or not the pipeline file is there, the rest is registered."""
    hide = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r} or name.startswith({name!r} + "."):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = set(e.queries())
assert "pipeline" not in names and "topn_per_date" in names, names
assert any(n.startswith("op") and n[2].isdigit() for n in names) == {kept}
assert set(e.oracle_sql()) <= names
"""
    root = Path(entry.__file__).parent
    for name, kept in (("panelspark.llm", False), ("corpus_pipeline", True)):
        subprocess.run([sys.executable, "-c", hide.format(name=name, kept=kept)], cwd=root, check=True, timeout=120)
