"""Registered queries: oracle agreement for a fast set, invariants for those SQL cannot state."""

import pytest

from compare import connect, differences
from panelsmith.queries import ORACLES, QUERIES

FAST = (
    "mc_splits", "kfold", "eb_prior", "moderated_t", "frozen_panel", "gaussian_nb", "summary_stage2",
    "panel_stability", "labelled_table", "grouped_adapter", "k_tagged_union", "weights_highest", "speed_up", "box_stats_runtime",
    "lda", "lda_oversampled", "knn_oversampled", "spearman_by_k",
)


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", FAST)
def test_query_equals_its_sql(spark, con, sf_dir, name):
    assert differences(spark, con, sf_dir, QUERIES[name], ORACLES[name]) == []


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def error_rate(rows):
    return sum(r["class"] != r["predicted"] for r in rows) / len(rows)


@pytest.mark.parametrize("name,best", [("lda", 0.3), ("svm_calibrated", 0.3), ("lasso_cv", 0.3)])
def test_planted_signal_is_learned(spark, sf_dir, name, best):
    rows = QUERIES[name](spark, sf_dir).collect()
    assert all(0 <= r["p_pos"] <= 1 for r in rows)
    keys = {(r["split"], r["K"], r["sample_ix"]) for r in rows}
    assert len(keys) == len(rows)
    assert error_rate(rows) < best
    if name == "lda":
        again = QUERIES[name](spark, sf_dir).collect()
        assert sorted(map(str, rows)) == sorted(map(str, again))


def test_planted_features_enter_every_panel(spark, sf_dir):
    from panelsmith.queries.selection_queries import study

    panels = study(spark, sf_dir, 5, rule="planted", k_list=(10,)).panels.collect()
    for split in range(1, 6):
        genes = {r["gene"] for r in panels if r["split"] == split}
        assert len(genes) == 10 and {"g0", "g1"} <= genes
