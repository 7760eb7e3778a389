"""Feature ranking by an empirical-Bayes moderated t, panels and their frequencies."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelsmith.design import Design
from panelsmith.functions.special import digamma, trigamma, trigamma_inverse

# Memory one task may use for its running sums.
_SUMS_BYTES = 256 * 2**20


def matrix_of(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """Rows of a list column of equal length as a 2-d array."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1)


def group_moments(roles: DataFrame, design: Design, centre: Sequence[float]) -> DataFrame:
    """Per (slot, gene): size, mean and sample variance of positives and of the rest.

    One pass over the matrix for all slots: per batch the training masks are
    multiplied with the features, so rows are never copied per split and the
    shuffle carries sums only. Values are taken relative to `centre`, the
    features of any one sample, before they are squared: that changes no result
    and avoids cancellation.
    """
    slots_at_once = max(1, _SUMS_BYTES // (len(centre) * 6 * 8))
    slim = roles.select((F.col("class") == design.pos).alias("is_pos"), "train", "features")
    parts = [
        _moments_of_slots(slim, centre, lo, min(lo + slots_at_once, design.n_slots))
        for lo in range(0, design.n_slots, slots_at_once)
    ]
    sums = parts[0]
    for part in parts[1:]:
        sums = sums.unionByName(part)

    def mean(g: str) -> Column:
        return F.try_divide(F.col(f"t{g}"), F.col(f"n{g}"))

    def variance(g: str) -> Column:
        n, s, q = F.col(f"n{g}"), F.col(f"s{g}"), F.col(f"q{g}")
        return F.when(n > 1, F.greatest(F.lit(0.0), (q - s * s / n) / (n - 1)))

    return (
        sums.groupBy("slot", "gene_ix")
        .agg(*[F.sum(f"{v}{g}").alias(f"{v}{g}") for g in "10" for v in "ntsq"])
        .select(
            "slot", "gene_ix", "n1", "n0",
            mean("1").alias("m1"), mean("0").alias("m0"),
            variance("1").alias("v1"), variance("0").alias("v0"),
        )
    )


def _moments_of_slots(slim: DataFrame, centre: Sequence[float], lo: int, hi: int) -> DataFrame:
    centre = np.asarray(centre, dtype=np.float64)
    schema = "slot int, gene_ix int, " + ", ".join(
        f"n{g} bigint, t{g} double, s{g} double, q{g} double" for g in "10"
    )

    def partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, n_slots = len(centre), hi - lo
        sums = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = matrix_of(batch["features"])
            d = x - centre
            d2 = d * d
            train = matrix_of(batch["train"], bool)[:, lo:hi]
            is_pos = batch["is_pos"].to_numpy(zero_copy_only=False).astype(bool)
            if sums is None:
                sums = {g: [np.zeros(n_slots, np.int64)] + [np.zeros((n_slots, width)) for _ in range(3)] for g in "10"}
            for g, members in (("1", is_pos), ("0", ~is_pos)):
                mask = (train & members[:, None]).astype(np.float64).T
                sums[g][0] += mask.sum(axis=1).astype(np.int64)
                for acc, values in zip(sums[g][1:], (x, d, d2)):
                    acc += mask @ values
        if sums is None:
            return
        step = max(1, 100_000 // width)
        for a in range(0, n_slots, step):
            b = min(a + step, n_slots)
            columns = {
                "slot": np.repeat(np.arange(lo + a, lo + b, dtype=np.int32), width),
                "gene_ix": np.tile(np.arange(width, dtype=np.int32), b - a),
            }
            for g in "10":
                columns[f"n{g}"] = np.repeat(sums[g][0][a:b], width)
                for v, acc in zip("tsq", sums[g][1:]):
                    columns[f"{v}{g}"] = acc[a:b].ravel()
            yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})

    return slim.mapInArrow(partial_sums, schema)


def pooled_variance(moments: DataFrame) -> DataFrame:
    """Two-group linear fit: residual df, pooled variance s2, group difference b and its scale u."""
    n1, n0 = F.col("n1"), F.col("n0")
    return moments.withColumns({
        "df": (n1 + n0 - 2).cast("double"),
        "s2": ((n1 - 1) * F.col("v1") + (n0 - 1) * F.col("v0")) / (n1 + n0 - 2),
        "b": F.col("m1") - F.col("m0"),
        "u": F.sqrt(1 / n1 + 1 / n0),
    })


def variance_prior(fit: DataFrame) -> DataFrame:
    """Per slot: prior df d0 (null = infinite) and prior variance s0sq."""
    medians = fit.groupBy("slot").agg(F.percentile("s2", F.lit(0.5)).alias("_median"))
    floor = F.when(F.col("_median") == 0, F.lit(1.0)).otherwise(F.col("_median")) * 1e-5
    moments = (
        fit.select("slot", "df", "s2")
        .join(medians, "slot")
        .select("slot", "df", F.greatest("s2", floor).alias("x"))
        .groupBy("slot")
        .agg(
            F.first("df").alias("df"),
            F.count(F.lit(1)).alias("genes"),
            F.avg("x").alias("mean_x"),
            F.avg(F.ln("x")).alias("mean_z"),
            F.var_samp(F.ln("x")).alias("var_z"),
        )
    )
    half_df, half_d0 = F.col("half_df"), F.col("half_d0")
    return (
        moments.withColumn("half_df", F.col("df") / 2)
        .withColumn("mean_e", F.col("mean_z") - digamma(half_df) + F.ln(half_df))
        .withColumn("evar", F.col("var_z") - trigamma(half_df))
        .withColumn("half_d0", F.when(F.col("evar") > 0, trigamma_inverse(F.col("evar"))))
        .select(
            "slot",
            # a single feature carries no information about the prior
            F.when(F.col("genes") == 1, F.lit(0.0)).otherwise(2 * half_d0).alias("d0"),
            F.when(half_d0.isNotNull(), F.exp(F.col("mean_e") + digamma(half_d0) - F.ln(half_d0)))
            .otherwise(F.col("mean_x")).alias("s0sq"),
            "mean_e",
            "evar",
        )
    )


def moderated_t(fit: DataFrame, prior: DataFrame) -> DataFrame:
    """Posterior variance and moderated t of every (slot, gene)."""
    d0, s0sq, df, s2 = (F.col(c) for c in ("d0", "s0sq", "df", "s2"))
    posterior = F.when(d0.isNull(), s0sq).otherwise((d0 * s0sq + df * s2) / (d0 + df))
    return (
        fit.join(prior.select("slot", "d0", "s0sq"), "slot")
        .withColumn("s2_post", posterior)
        .withColumn("t", F.col("b") / (F.col("u") * F.sqrt("s2_post")))
    )


def rank_features(ranked: DataFrame, top: int) -> DataFrame:
    """The `top` features of each slot by |t|, with their rank (ties by position)."""
    order = Window.partitionBy("slot").orderBy(F.desc(F.abs("t")), "gene_ix")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def cut_panels(ranked: DataFrame, k_list: Sequence[int]) -> DataFrame:
    """Panels of every size from one ranking: rank once, cut many."""
    sizes = F.explode(F.filter(F.array(*[F.lit(k) for k in k_list]), lambda k: k >= F.col("rank"))).alias("K")
    return ranked.select("*", sizes)


def selection_frequency(panels: DataFrame, *keys: str) -> DataFrame:
    """How often each gene was selected, per K (and per replicate when asked)."""
    return panels.groupBy(*keys, "K", "gene").agg(F.count(F.lit(1)).alias("count"))


def frozen_panels(freq: DataFrame, *keys: str) -> DataFrame:
    """The K most often selected genes per K; ties by gene id.

    Ids compare as numbers where every id of the panel size is a number,
    otherwise as text.
    """
    groups = [*keys, "K"]
    numeric = freq.groupBy(*groups).agg(
        F.bool_and(F.col("gene").rlike(r"^-?[0-9]+(\.[0-9]+)?$")).alias("_numeric")
    )
    order = Window.partitionBy(*groups).orderBy(F.desc("count"), "_number", "gene")
    return (
        freq.join(numeric, groups)
        .withColumn("_number", F.when(F.col("_numeric"), F.col("gene").try_cast("double")))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= F.col("K"))
        .drop("_numeric", "_number")
    )


def rank_vector(panel: DataFrame, genes: str = "genes") -> DataFrame:
    """One (gene, rank) row per entry of an ordered gene list, rank from 1."""
    others = [c for c in panel.columns if c != genes]
    return panel.select(*others, F.posexplode(genes).alias("_at", "gene")).select(
        *others, "gene", (F.col("_at") + 1).alias("rank")
    )
