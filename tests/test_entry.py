"""The entry module: its contract, and the queries against DuckDB."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
#: One query of each family; the whole set is compared by the driver.
SOME = ["long_to_nested", "cutoff_timestamp", "length_filter", "seasonal_naive", "ffill", "mase", "wql", "metrics_with_nulls", "multi_target_mean", "leaderboard", "pairwise_win_skill", "invalid_predictions", "past_plus_future", "streaming_scores", "prediction_mismatch", "flat_forecasts", "cutoff_times", "loaded_summaries", "filtered_results", "bootstrap_interval"]


def compare(frame, oracle):
    assert sorted(frame.columns) == sorted(oracle.columns)
    names = sorted(frame.columns)
    rows = lambda df: sorted((tuple(r) for r in df[names].astype(object).where(df[names].notna(), None).values.tolist()), key=lambda r: tuple(map(str, r)))
    a, b = rows(frame), rows(oracle)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert [v if not isinstance(v, float) else pytest.approx(v, rel=1e-9, abs=2e-5) for v in y] == list(x)


@pytest.mark.parametrize("name", SOME)
def test_queries_equal_sql(spark, small, name):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    compare(entry.queries()[name](spark, small).toPandas(), con.sql(entry.oracle_sql()[name]).df())


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 80
    assert entry.entry(spark).count() == 2


def test_imports_without_the_llm_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/tsmeter", tmp_path / "tsmeter", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert not [q for q in e.queries() if q.startswith('op')], 1; print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
