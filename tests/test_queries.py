"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from riskgrid.plans import catalogue, model_queries, table_queries  # noqa: F401  (the others add to the first)

SF = "/root/testdata/sf0.001"
PICKED = [
    "ag1_default_summary_by_count", "ag1_default_summary_with_missing", "ag2_distribution_summary", "ag4_missing_table", "ag8_contingency_margins", "ag10_relative_gaps", "ag12_describe", "bn3_quantile_bins_dropping_equal_edges",
    "bn6_vingtiles", "dp2_winsorize", "sa1_kruskal_wallis", "sa5_cramers_v_matrix_corrected", "ps7_psi_between_samples", "wo1_woe_table", "vs1_keep_associated", "me_metrics", "sc4_contributions", "sc7_risk_classes", "sc10_class_summary", "lm_one_variable_search",
    "sa8_contingency_test", "sa8_contingency_analysis_table", "sm4_sample", "vz_rates_by_quantile_bin", "vz_rates_by_distinct_bin", "vz_rates_by_width_bin", "pr1_period_chain", "io8_folds_written_and_read", "io1_csv_written_and_read",
    "lm5_single_model_checks", "lm15_models_scored_together", "sc5_score_outputs", "vz8_box_statistics", "vz8_density_by_category", "ag1_declared_categories", "bn5_cutoffs_from_saved_intervals", "t7_label_directions", "lm17_area_of_short_roc",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def printed(frame) -> list[tuple]:
    def cell(v):
        if v is None or v != v:
            return "null"
        return f"{v:.6f}" if isinstance(v, float) and math.isfinite(v) else f"{v:.6f}" if isinstance(v, int) and not isinstance(v, bool) else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(cell(v) for v in row) for row in frame.astype(object).itertuples(index=False))


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", PICKED)
def test_query_matches_sql(spark, duck, name):
    got = printed(catalogue.QUERIES[name](spark, SF).toPandas())
    want = printed(duck.execute(catalogue.ORACLES[name]).df())
    assert got == want


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", ["sc8_class_stability", "sc8_class_stability_summary", "sc8_share_matrix", "sc8_default_rate_matrix"])
def test_stability_of_classes_matches_sql_without_the_book_in_order(spark, duck, monkeypatch, name):
    monkeypatch.setattr(catalogue, "loan_book", None)
    assert printed(catalogue.QUERIES[name](spark, SF).toPandas()) == printed(duck.execute(catalogue.ORACLES[name]).df())


def test_every_query_but_searches_has_sql():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == {"lm11_model_search", "e2e_scorecard_pipeline"}


def test_entry_imports_without_the_other_subpackage(tmp_path):
    root = Path(__file__).parents[1]
    shutil.copytree(root / "riskgrid", tmp_path / "riskgrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), set(e.oracle_sql()) <= set(q), any(n.startswith('op') or n == 'pipeline' for n in q))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert said.stdout.split() == [str(len(catalogue.QUERIES)), "True", "False"], said.stderr
