"""Linear discriminant with full pooled covariance and empirical priors.

The samples are only summed (class means, within-class scatter); each cell's
small system is then solved from its sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelsmith.design import Design
from panelsmith.operators.cells import decided
from panelsmith.operators.models.linear import cell_means, dot, sigmoid, unpacked, within_scatter
from panelsmith.session import settle

# Fixed value: relative size below which a direction of the scatter counts as empty.
RANK_TOLERANCE = 1e-4


def discriminant(ss: np.ndarray, m1: np.ndarray, m0: np.ndarray, n1: int, n0: int) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of the log odds of the positive class.

    The scatter is brought to unit within-class deviations, and directions
    whose singular value does not exceed the tolerance are left out.
    """
    n = n1 + n0
    dev = np.sqrt(np.diag(ss) / n)
    dev[dev == 0] = 1.0
    values, vectors = np.linalg.eigh(ss / np.outer(dev, dev) / max(n - 2, 1))
    kept = np.sqrt(np.maximum(values, 0.0)) > RANK_TOLERANCE
    whiten = vectors[:, kept] / np.sqrt(values[kept]) / dev[:, None]
    coef = whiten @ (whiten.T @ (m1 - m0))
    return coef, float(np.log(n1 / n0) - coef @ (m1 + m0) / 2)


def fit_models(train: DataFrame) -> DataFrame:
    """(slot, K, coef, intercept) from training cell rows."""
    sums = within_scatter(train, settle(cell_means(train), "means"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coefs, intercepts = [], []
            for i in range(batch.num_rows):
                coef, intercept = discriminant(
                    unpacked(batch["ss"][i].values.to_numpy()),
                    batch["m1"][i].values.to_numpy(), batch["m0"][i].values.to_numpy(),
                    batch["n1"][i].as_py(), batch["n0"][i].as_py(),
                )
                coefs.append(coef)
                intercepts.append(intercept)
            yield pa.RecordBatch.from_pydict({
                "slot": batch["slot"], "K": batch["K"],
                "coef": pa.array(coefs, pa.list_(pa.float64())), "intercept": pa.array(intercepts, pa.float64()),
            })

    return sums.mapInArrow(solve, "slot int, K int, coef array<double>, intercept double")


def predict(train: DataFrame, test: DataFrame, design: Design, name: str = "LDA") -> DataFrame:
    models = settle(fit_models(train), "lda")
    scored = test.join(models, ["slot", "K"]).withColumn(
        "p_pos", sigmoid(dot("x", "coef") + F.col("intercept"))
    )
    return decided(scored, name, design)
