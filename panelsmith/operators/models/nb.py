"""Gaussian naive Bayes with class-wise variances.

The per-class moments are those of the feature ranking, so fitting needs no
further pass over the samples: the model of a cell is a lookup of its panel in
the (slot, gene) moments.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from panelsmith.design import Design
from panelsmith.operators.cells import decided

# Fixed value: share of the largest variance added to every variance.
VAR_SMOOTHING = 1e-9


def population_moments(fit: DataFrame) -> DataFrame:
    """Add population variances per class (p1, p0) and over all training rows (p)."""
    n1, n0, m1, m0 = (F.col(c) for c in ("n1", "n0", "m1", "m0"))
    n = n1 + n0
    mean = (n1 * m1 + n0 * m0) / n
    return fit.withColumns({
        "p1": F.col("v1") * (n1 - 1) / n1,
        "p0": F.col("v0") * (n0 - 1) / n0,
    }).withColumn(
        "p",
        (n1 * (F.col("p1") + (m1 - mean) * (m1 - mean)) + n0 * (F.col("p0") + (m0 - mean) * (m0 - mean))) / n,
    )


def fit_models(fit: DataFrame, panels: DataFrame, balanced: bool = False) -> DataFrame:
    """(slot, K, stats, prior): per-feature parameters of each cell in rank order.

    Balanced weights are constant within a class: they leave the class moments
    as they are and make the priors equal.
    """
    stats = F.struct("rank", "m1", "m0", "p1", "p0")
    cells = panels.select("slot", "K", "rank", "gene_ix").join(population_moments(fit), ["slot", "gene_ix"])
    grouped = cells.groupBy("slot", "K").agg(
        F.array_sort(F.collect_list(stats)).alias("stats"),
        (F.max("p") * VAR_SMOOTHING).alias("eps"),
        F.first("n1").alias("n1"),
        F.first("n0").alias("n0"),
    )
    prior = F.lit(0.0) if balanced else F.ln(F.col("n1") / F.col("n0"))
    eps = F.col("eps")
    smoothed = F.transform("stats", lambda s: F.struct(
        s.m1.alias("m1"), s.m0.alias("m0"), (s.p1 + eps).alias("p1"), (s.p0 + eps).alias("p0")
    ))
    return grouped.select("slot", "K", smoothed.alias("stats"), prior.alias("prior"))


def _log_density(x: Column, m: Column, v: Column) -> Column:
    return -0.5 * (F.ln(v) + math.log(2 * math.pi)) - (x - m) * (x - m) / (2 * v)


def predict(rows: DataFrame, models: DataFrame, design: Design, name: str = "DLDA") -> DataFrame:
    """Score cell rows (slot, K, sample_ix, class, x)."""
    terms = F.zip_with(
        "x", "stats",
        lambda x, s: _log_density(x, s.m1, s.p1) - _log_density(x, s.m0, s.p0),
    )
    score = F.col("prior") + F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)
    scored = rows.join(models, ["slot", "K"]).withColumn("_score", score)
    return decided(scored.withColumn("p_pos", 1 / (1 + F.exp(-F.col("_score")))), name, design)
