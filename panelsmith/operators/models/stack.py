"""Stacked ensemble: out-of-fold probabilities of the base models, weighted by an l1 logistic fit."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelsmith.design import Design, N_FOLDS
from panelsmith.operators.cells import decided
from panelsmith.operators.models.linear import dot, sigmoid
from panelsmith.operators.models.solver import Fit, Problem, solve
from panelsmith.session import settle

# Order of the base models in the weights, with the names of their predictions.
BASES = (("rf", "RF"), ("svm", "SVM"), ("lasso", "Lasso"), ("knn", "kNN"), ("lda", "LDA"), ("dlda", "DLDA"))
META = Problem(loss="logistic", lasso=1.0, bias=True)


def last_class(design: Design) -> str:
    """The class whose probability the stack sees: the one that sorts last."""
    return max(design.pos, design.neg)


def stacked_columns(predictions: DataFrame, design: Design) -> DataFrame:
    """(slot, K, sample_ix, class, x): base probabilities of the last class, in base order."""
    p = F.col("p_pos") if last_class(design) == design.pos else 1 - F.col("p_pos")
    wide = predictions.groupBy("slot", "K", "sample_ix", "class").pivot("model", [m for _, m in BASES]).agg(F.first(p))
    return wide.select("slot", "K", "sample_ix", "class", F.array(*[F.col(m) for _, m in BASES]).alias("x"))


def fit_meta(inner: DataFrame, design: Design, n_folds: int = N_FOLDS) -> list[Fit]:
    """One meta fit per cell from the out-of-fold predictions of the inner slots."""
    rows = stacked_columns(inner, design).select(
        F.floor(F.col("slot") / n_folds).cast("int").alias("slot"), "K",
        F.array(F.lit(0)).alias("codes"), (F.col("class") == last_class(design)).alias("is_pos"), "x",
    )
    rows = settle(rows, "meta")
    cells = rows.select("slot", "K").distinct().collect()
    fits = [Fit(slot=r["slot"], K=r["K"], width=len(BASES)) for r in cells]
    return solve(rows, fits, META)


def weights(spark, fits: list[Fit]) -> DataFrame:
    """(slot, K, base, weight): meta coefficients by base model."""
    table = spark.createDataFrame([(f.slot, f.K, [float(v) for v in f.coef]) for f in fits], "slot int, K int, coef array<double>")
    names = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(BASES)], "at int, base string")
    return table.select("slot", "K", F.posexplode("coef").alias("at", "weight")).join(names, "at").select(
        "slot", "K", "base", "weight"
    )


def predict(outer: DataFrame, fits: list[Fit], design: Design, name: str = "SuperLearner") -> DataFrame:
    """Score the test rows from the predictions of the refitted base models."""
    models = outer.sparkSession.createDataFrame(
        [(f.slot, f.K, [float(v) for v in f.coef], f.intercept) for f in fits],
        "slot int, K int, coef array<double>, intercept double",
    )
    p_last = sigmoid(dot("x", "coef") + F.col("intercept"))
    p_pos = p_last if last_class(design) == design.pos else 1 - p_last
    return decided(stacked_columns(outer, design).join(models, ["slot", "K"]).withColumn("p_pos", p_pos), name, design)
