"""Logistic regression with an l1 penalty and no intercept; penalty chosen by inner folds."""

from __future__ import annotations

from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame, functions as F

from panelsmith.design import Design, N_FOLDS
from panelsmith.operators.cells import decided
from panelsmith.operators.models.linear import dot, sigmoid
from panelsmith.operators.models.solver import Fit, Problem, held_losses, solve

# The penalty grid, 12 points from 0.01 to 10 on a log scale.
C_GRID = tuple(10.0 ** (-2 + 3 * i / 11) for i in range(12))
PROBLEM = Problem(loss="logistic", lasso=1.0)


def fit_models(rows: DataFrame, cells: list[tuple[int, int, int, int, int]], n_folds: int = N_FOLDS) -> list[Fit]:
    """Best fit of each cell. A cell is (slot, row slot, row K, lane, width).

    All penalties and folds of all cells are fitted together; the penalty with
    the lowest mean held-out loss (the smaller C on a tie) is refitted on all
    training rows.
    """
    grid = [
        Fit(slot=rs, K=rk, lane=lane, width=width, C=c, held=h, tag={"cell": n, "slot": slot})
        for n, (slot, rs, rk, lane, width) in enumerate(cells)
        for h in range(n_folds)
        for c in C_GRID
    ]
    solve(rows, grid, PROBLEM)
    losses = held_losses(rows, grid)
    final = []
    for n, members in groupby(range(len(grid)), key=lambda i: grid[i].tag["cell"]):
        by_c = {c: [] for c in C_GRID}
        for i in members:
            by_c[grid[i].C].append(losses[i])
        best = min(C_GRID, key=lambda c: np.mean(by_c[c]))
        slot, rs, rk, lane, width = cells[n]
        final.append(Fit(slot=rs, K=rk, lane=lane, width=width, C=best, tag={"cell": n, "slot": slot}))
    return solve(rows, final, PROBLEM)


def model_table(spark, fits: list[Fit]) -> DataFrame:
    """(slot, K, coef, C) of the chosen fits."""
    return spark.createDataFrame(
        [(f.tag["slot"], f.K, [float(v) for v in f.coef], float(f.C)) for f in fits],
        "slot int, K int, coef array<double>, C double",
    )


def predict(test: DataFrame, models: DataFrame, design: Design, name: str = "Lasso") -> DataFrame:
    scored = test.join(models, ["slot", "K"]).withColumn("p_pos", sigmoid(dot("x", "coef")))
    return decided(scored, name, design)


def shared_rows(folded: DataFrame, pos: str) -> DataFrame:
    """All-feature training rows, one per sample: every slot is a lane of the same cell."""
    return folded.select(
        F.lit(-1).alias("slot"), F.lit(0).alias("K"), F.col("fold").alias("codes"),
        (F.col("class") == pos).alias("is_pos"), F.col("features").alias("x"),
    )
