"""Linear support-vector machine on scaled features with sigmoid calibration over inner folds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from panelsmith.design import Design, N_FOLDS
from panelsmith.operators.cells import decided
from panelsmith.operators.models.linear import dot, sigmoid
from panelsmith.operators.models.solver import Fit, Problem, solve
from panelsmith.session import settle

MARGIN = Problem(loss="squared_hinge", ridge=1.0, bias=True)
SIGMOID = Problem(loss="logistic", bias=True)


def fold_counts(rows: DataFrame) -> dict[tuple[int, int, int], tuple[int, int]]:
    """(positives, negatives) per (slot, K, fold)."""
    counts = rows.groupBy("slot", "K", "fold").agg(F.count_if("is_pos").alias("p"), F.count_if(~F.col("is_pos")).alias("n"))
    return {(r["slot"], r["K"], r["fold"]): (r["p"], r["n"]) for r in counts.collect()}


def outside_deviations(rows: DataFrame, n_folds: int) -> dict[tuple[int, int, int], np.ndarray]:
    """Feature deviations over the rows outside each fold, from per-fold means and variances."""
    moments = (
        rows.select("slot", "K", "fold", F.posexplode("x").alias("i", "v"))
        .groupBy("slot", "K", "fold", "i")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("var"))
        .groupBy("slot", "K", "fold")
        .agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "mean", "var"))).alias("m"))
        .select("slot", "K", "fold", "n", F.col("m.mean").alias("mean"), F.col("m.var").alias("var"))
    )
    cells: dict[tuple[int, int], dict[int, tuple]] = {}
    for r in moments.collect():
        cells.setdefault((r["slot"], r["K"]), {})[r["fold"]] = (r["n"], np.array(r["mean"]), np.array(r["var"]))
    out = {}
    for (slot, k), folds in cells.items():
        for held in range(n_folds):
            others = [v for f, v in folds.items() if f != held]
            n = sum(v[0] for v in others)
            mean = sum(v[0] * v[1] for v in others) / n
            var = sum(v[0] * (v[2] + (v[1] - mean) ** 2) for v in others) / n
            dev = np.sqrt(var)
            out[slot, k, held] = np.where(dev == 0, 1.0, dev)
    return out


def fit_models(rows: DataFrame, balanced: bool = False, n_folds: int = N_FOLDS) -> list[tuple[Fit, Fit]]:
    """(margin fit, sigmoid fit) per cell and fold. Rows: slot, K, fold, is_pos, x (training rows)."""
    spark = rows.sparkSession
    counts, deviations = fold_counts(rows), outside_deviations(rows, n_folds)
    margins = []
    for (slot, k, held), scale in sorted(deviations.items(), key=lambda kv: kv[0]):
        others = [counts.get((slot, k, f), (0, 0)) for f in range(n_folds) if f != held]
        p, n = sum(c[0] for c in others), sum(c[1] for c in others)
        weights = ((p + n) / (2 * p), (p + n) / (2 * n)) if balanced else (1.0, 1.0)
        margins.append(Fit(slot=slot, K=k, width=len(scale), held=held, weights=weights, scale=scale))
    coded = rows.withColumn("codes", F.array("fold"))
    solve(coded, margins, MARGIN)
    table = spark.createDataFrame(
        [(f.slot, f.K, f.held, [float(v) for v in f.coef], f.intercept) for f in margins],
        "slot int, K int, fold int, coef array<double>, intercept double",
    )
    # stored once: every step of the sigmoid fits reads them
    held_rows = settle(coded.join(table, ["slot", "K", "fold"]).select(
        "slot", "K", "codes", "is_pos", F.array(dot("x", "coef") + F.col("intercept")).alias("x")
    ), "margins")
    sigmoids = []
    for f in margins:
        p, n = counts.get((f.slot, f.K, f.held), (0, 0))
        # soft targets keep the sigmoid finite where the margin separates the classes
        sigmoids.append(Fit(slot=f.slot, K=f.K, width=1, held=f.held, inside=True, targets=((p + 1) / (p + 2), 1 / (n + 2))))
    solve(held_rows, sigmoids, SIGMOID)
    return list(zip(margins, sigmoids))


def model_table(spark, fits: list[tuple[Fit, Fit]]) -> DataFrame:
    """(slot, K, members): the calibrated members of each cell."""
    cells: dict[tuple[int, int], list] = {}
    for m, s in fits:
        cells.setdefault((m.slot, m.K), []).append(
            ([float(v) for v in m.coef], m.intercept, float(s.coef[0]), s.intercept)
        )
    return spark.createDataFrame(
        [(slot, k, members) for (slot, k), members in cells.items()],
        "slot int, K int, members array<struct<coef: array<double>, intercept: double, a: double, b: double>>",
    )


def predict(test: DataFrame, models: DataFrame, design: Design, name: str = "SVM") -> DataFrame:
    """Mean of the members' calibrated probabilities."""
    x = F.col("x")
    each = F.transform("members", lambda m: sigmoid(m.a * (dot(x, m.coef) + m.intercept) + m.b))
    p = F.aggregate(each, F.lit(0.0), lambda s, v: s + v) / F.size("members")
    return decided(test.join(models, ["slot", "K"]).withColumn("p_pos", p), name, design)
