"""Error measures per split, their summaries, ensemble-weight tables and panel stability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Names of the summary measures and the columns they summarise.
MEASURES = {"MCE": "MCE", "Sens": "Sensitivity", "Spec": "Specificity"}
TIMES = {"Train": "train_s", "Pred": "pred_s"}


def confusion(predictions: DataFrame, keys: Sequence[str], pos: str, neg: str) -> DataFrame:
    """tp, tn, fp, fn among rows labelled with the pair; `rows` counts all test rows."""
    truth, guess = F.col("class"), F.col("predicted")
    return predictions.groupBy(*keys).agg(
        F.count_if((truth == pos) & (guess == pos)).alias("tp"),
        F.count_if((truth == neg) & (guess == neg)).alias("tn"),
        F.count_if((truth == neg) & (guess == pos)).alias("fp"),
        F.count_if((truth == pos) & (guess == neg)).alias("fn"),
        F.count(F.lit(1)).alias("rows"),
    )


def split_metrics(counts: DataFrame) -> DataFrame:
    """MCE, Sensitivity, Specificity; null where the denominator is 0."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return counts.withColumns({
        "MCE": 1 - F.try_divide(tp + tn, F.col("rows")),
        "Sensitivity": F.try_divide(tp, tp + fn),
        "Specificity": F.try_divide(tn, tn + fp),
    }).drop("tp", "tn", "fp", "fn", "rows")


def standard_error(column: str) -> Column:
    """Sample deviation over the root of the row count, rows without a value included."""
    return F.stddev_samp(column) / F.sqrt(F.count(F.lit(1)))


def summary(metrics: DataFrame, keys: Sequence[str] = ("model", "K"), timed: bool = False) -> DataFrame:
    """Mean and standard error per key; with times also their totals."""
    aggs = []
    for short, column in {**MEASURES, **(TIMES if timed else {})}.items():
        aggs += [F.avg(column).alias(f"{short}_mean"), standard_error(column).alias(f"{short}_se")]
    if timed:
        aggs += [F.sum(column).alias(f"{short}_total") for short, column in TIMES.items()]
    return metrics.groupBy(*keys).agg(*aggs)


def canonical_names(table: DataFrame, with_errors: bool = False) -> DataFrame:
    """Rename metric columns of any known spelling to MCE, Sensitivity, Specificity."""
    spellings = {
        "MCE": ("mce", "mce_mean"),
        "Sensitivity": ("sensitivity", "sens_mean", "sensitivity_mean"),
        "Specificity": ("specificity", "spec_mean", "specificity_mean"),
    }
    if with_errors:
        spellings |= {
            "MCE_se": ("mce_se",),
            "Sensitivity_se": ("sens_se", "sensitivity_se"),
            "Specificity_se": ("spec_se", "specificity_se"),
        }
    known = {s: name for name, options in spellings.items() for s in options}
    return table.withColumnsRenamed({c: known[c.lower()] for c in table.columns if c.lower() in known})


# --- ensemble weights -----------------------------------------------------------------------


def unify_weights(table: DataFrame) -> DataFrame:
    """Any of the three weight layouts as (…, model, weight)."""
    if "weight" in table.columns:
        return table.withColumnRenamed("base", "model") if "model" not in table.columns else table
    keys = [c for c in ("K", "stage", "split") if c in table.columns] or table.columns[:1]
    bases = [c for c in table.columns if c not in keys]
    return table.unpivot(keys, bases, "model", "weight")


def with_weight_columns(table: DataFrame, weights: DataFrame, bases: Sequence[str]) -> DataFrame:
    """Split metrics with SL_w_<base> columns, filled on the rows of the ensemble only."""
    keys = [c for c in ("stage", "K", "split") if c in weights.columns]
    wide = weights.groupBy(*keys).pivot("base", list(bases)).agg(F.first("weight"))
    wide = wide.withColumnsRenamed({b: f"SL_w_{b}" for b in bases}).withColumn("model", F.lit("SuperLearner"))
    return table.join(wide, [*keys, "model"], "left")


def mean_weights(weights: DataFrame) -> DataFrame:
    return weights.groupBy("K", "model").agg(F.avg("weight").alias("weight"))


def weights_matrix(weights: DataFrame, k_list: Sequence[int]) -> DataFrame:
    """Mean weight, one row per model and one column per K."""
    return weights.groupBy("model").pivot("K", list(k_list)).agg(F.avg("weight"))


def positive_counts(weights: DataFrame) -> DataFrame:
    return weights.where(F.col("weight") > 0).groupBy("K", "model").agg(F.count(F.lit(1)).alias("count"))


def highest_counts(weights: DataFrame, order: Column) -> DataFrame:
    """How often a model has the highest weight of its split; the first in `order` wins ties."""
    best = weights.where(F.col("weight").isNotNull()).groupBy("K", "split").agg(
        F.max_by("model", F.struct(F.col("weight"), -order)).alias("model")
    )
    return best.groupBy("K", "model").agg(F.count(F.lit(1)).alias("count"))


def zero_filled(counts: DataFrame) -> DataFrame:
    """Every model for every K, absent combinations as 0."""
    grid = counts.groupBy().agg(
        F.collect_set("model").alias("models"), F.collect_set("K").alias("ks")
    ).select(F.explode("models").alias("model"), "ks").select("model", F.explode("ks").alias("K"))
    return grid.join(counts, ["model", "K"], "left").select(
        "model", "K", F.coalesce("count", F.lit(0)).cast("bigint").alias("count")
    )


# --- panel stability ------------------------------------------------------------------------


def panel_lists(panels: DataFrame, ident: str) -> DataFrame:
    """(K, id, genes): each panel as an ordered list."""
    return panels.groupBy("K", F.col(ident).alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "gene"))).alias("_o")
    ).select("K", "id", F.col("_o.gene").alias("genes"))


def panel_pairs(lists: DataFrame) -> DataFrame:
    """All unordered pairs of panels of one K; their number is set by the design, not the data."""
    a = lists.select("K", F.col("id").alias("a"), F.col("genes").alias("genes_a"))
    b = lists.select("K", F.col("id").alias("b"), F.col("genes").alias("genes_b"))
    return a.join(b, "K").where(F.col("a") < F.col("b"))


def jaccard(a: str, b: str) -> Column:
    return F.coalesce(
        F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0)
    )


def pair_similarity(lists: DataFrame) -> DataFrame:
    return panel_pairs(lists).select("K", "a", "b", jaccard("genes_a", "genes_b").alias("jaccard"))


def stability(original: DataFrame, aggregated: DataFrame) -> DataFrame:
    """(K, Metric, Value): mean and population deviation of pairwise similarity, both panel sources.

    A K with fewer than two panels of a source has null values.
    """

    def measured(lists: DataFrame, name: str) -> DataFrame:
        sizes = lists.select("K").distinct()
        values = pair_similarity(lists).groupBy("K").agg(
            F.avg("jaccard").alias(f"{name}_Jaccard_Mean"),
            F.stddev_pop("jaccard").alias(f"{name}_Jaccard_Std"),
        )
        return sizes.join(values, "K", "left")

    wide = measured(original, "Original").join(measured(aggregated, "Aggregated"), "K", "full")
    return wide.unpivot("K", [c for c in wide.columns if c != "K"], "Metric", "Value")


def stability_by_k(table: DataFrame) -> DataFrame:
    """Mean value per K and metric, one column per metric, absent deviations as 0."""
    names = [f"{s}_Jaccard_{m}" for s in ("Original", "Aggregated") for m in ("Mean", "Std")]
    wide = table.groupBy("K").pivot("Metric", names).agg(F.avg("Value"))
    return wide.fillna(0.0, [n for n in names if n.endswith("Std")])


def spearman_pairs(panels: DataFrame, ident: str) -> DataFrame:
    """Rank correlation of two panels over the genes they share (at least two)."""
    side = panels.select("K", F.col(ident).alias("id"), "gene", "rank")
    a = side.select("K", "gene", F.col("id").alias("a"), F.col("rank").alias("rank_a"))
    b = side.select("K", "gene", F.col("id").alias("b"), F.col("rank").alias("rank_b"))
    shared = a.join(b, ["K", "gene"]).where(F.col("a") < F.col("b"))
    pair = Window.partitionBy("K", "a", "b")
    again = shared.select(
        "K", "a", "b",
        F.row_number().over(pair.orderBy("rank_a")).cast("double").alias("ra"),
        F.row_number().over(pair.orderBy("rank_b")).cast("double").alias("rb"),
    )
    return (
        again.groupBy("K", "a", "b")
        .agg(F.count(F.lit(1)).alias("common"), F.corr("ra", "rb").alias("spearman"))
        .where("common >= 2")
        # one zero, not two
        .withColumn("spearman", F.when(F.abs("spearman") < 1e-12, 0.0).otherwise(F.col("spearman")))
    )


def spearman_by_k(pairs: DataFrame) -> DataFrame:
    """(K, pairs, Spearman_Mean, Spearman_Std): mean and population deviation over the pairs of panels that can be compared."""
    return pairs.groupBy("K").agg(
        F.count(F.lit(1)).alias("pairs"), F.avg("spearman").alias("Spearman_Mean"), F.stddev_pop("spearman").alias("Spearman_Std")
    )


def keyed_metrics(table: DataFrame) -> DataFrame:
    """Stability rows with their metric's name in lower case, by which figures look it up."""
    return table.withColumn("metric_key", F.lower("Metric"))
