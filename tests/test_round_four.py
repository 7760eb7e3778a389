"""What grows with the rows stays off the driver."""

import re

import numpy as np
import pytest

from panelsmith.design import Design
from panelsmith.operators import smote
from panelsmith.operators.models import forest


def test_draws_of_synthetic_rows_are_not_broadcast(spark):
    n = 30_000
    rows = [(0, 1, i, "Cancer" if i % 3000 == 0 else "Control", i % 3000 == 0, [float(i)]) for i in range(n)]
    train = spark.createDataFrame(rows, "slot int, K int, sample_ix long, class string, is_pos boolean, x array<double>")
    extra = smote.synthetic(train, Design(n_splits=1))
    # the draws (j) are stored, in several pieces, before they are joined: joins are planned by their true number
    assert len([f for f in extra.inputFiles() if "smote-draws" in f]) > 1
    assert not re.search(r"Generate explode.*\[j#", extra._jdf.queryExecution().optimizedPlan().toString())
    assert sorted(r["j"] for r in extra.select("j").collect()) == list(range(1, n - 20 + 1))


def forest_rows(slot, n, p, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, (n, p)).astype(float)
    x[:, 0] = 1.0  # nothing to cut
    positive = x[:, -1] + rng.normal(0, 3, n) > 8
    train = [(slot, p, i, bool(positive[i]), x[i].tolist()) for i in range(n)]
    return train, [(slot, p, 1000 + i, "Cancer", (x[i] + 0.25).tolist()) for i in range(n // 3)]


@pytest.mark.parametrize("balanced", [False, True])
def test_trees_do_not_depend_on_the_size_of_a_cell(spark, balanced):
    train, test = (sum(part, []) for part in zip(forest_rows(0, 50, 4, 1), forest_rows(1, 60, 9, 2)))
    train = spark.createDataFrame(train, "slot int, K int, sample_ix long, is_pos boolean, x array<double>").repartition(3)
    test = spark.createDataFrame(test, "slot int, K int, sample_ix long, class string, x array<double>").repartition(2)
    whole, spread = (
        {(r.slot, r.sample_ix): (r.p_pos, r.predicted) for r in forest.predict(
            train, test, Design(n_splits=2), balanced, trees=12, local_rows=most).collect()}
        for most in (1000, 25)
    )
    assert len(whole) == 50 // 3 + 60 // 3 and set(whole) == set(spread)
    assert all(spread[k][0] == pytest.approx(whole[k][0], abs=1e-12) and spread[k][1] == whole[k][1] for k in whole)
