"""The numbers behind the figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from panelsmith.operators.ranking import count_quantiles

# Genes shown in the frequency figure; whisker reach in quartile distances.
TOP_GENES = 30
WHISKER = 1.5
METRICS = ("MCE", "Sensitivity", "Specificity")


def top_genes(freq: DataFrame, top: int = TOP_GENES) -> DataFrame:
    """The most often selected genes of each K."""
    order = Window.partitionBy("K").orderBy(F.desc("count"), "gene")
    return freq.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def metric_lines(metrics: DataFrame) -> DataFrame:
    """Metrics per split, in split order within a model and panel size."""
    return metrics.select("model", "K", "split", *METRICS).orderBy("model", "K", "split")


def melted(metrics: DataFrame, ids: Sequence[str], values: Sequence[str] = METRICS) -> DataFrame:
    return metrics.unpivot(list(ids), list(values), "Metric", "Score")


def box_stats(long: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Quartiles, whiskers at the last value within 1.5 quartile distances, and outlier counts."""
    keys = list(keys)
    quartiles = count_quantiles(long, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = WHISKER * (F.col("q3") - F.col("q1"))
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    # equal values are merged first: the second pass moves distinct values, not rows
    counts = long.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ends = counts.join(quartiles.select(*keys, "q1", "q3"), keys).groupBy(*keys).agg(
        F.min(F.when(inside, F.col(value))).alias("lo_whisker"),
        F.max(F.when(inside, F.col(value))).alias("hi_whisker"),
        F.sum(F.when(inside, F.lit(0)).otherwise(F.col("_n"))).alias("outliers"),
    )
    return quartiles.join(ends, keys)


def se_band(summary: DataFrame, short: str) -> DataFrame:
    """Mean and mean ± SE over K per model."""
    m, se = F.col(f"{short}_mean"), F.col(f"{short}_se")
    return summary.select("model", "K", m.alias("mean"), (m - se).alias("lower"), (m + se).alias("upper"))


def stability_band(by_k: DataFrame) -> DataFrame:
    """(K, series, mean, lower, upper) for the original and the aggregated panels."""
    rows = [
        F.struct(
            F.lit(s).alias("series"),
            F.col(f"{s}_Jaccard_Mean").alias("mean"),
            (F.col(f"{s}_Jaccard_Mean") - F.col(f"{s}_Jaccard_Std")).alias("lower"),
            (F.col(f"{s}_Jaccard_Mean") + F.col(f"{s}_Jaccard_Std")).alias("upper"),
        )
        for s in ("Original", "Aggregated")
    ]
    return by_k.select("K", F.inline(F.array(*rows)))
