"""Fitting cells: the rows of one slot restricted to one panel.

A cell is (slot, K). Nested cross-validation is expressed as more slots: slot
`s * n_folds + f` trains on the training rows of `s` outside fold `f` and
evaluates the rows of that fold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from panelsmith.design import Design, N_FOLDS
from panelsmith.operators.ranking import id_bucket, numbered


def panel_arrays(panels: DataFrame) -> DataFrame:
    """(slot, K, idx): feature positions of each panel in rank order."""
    return panels.groupBy("slot", "K").agg(
        F.array_sort(F.collect_list(F.struct("rank", "gene_ix"))).alias("_o")
    ).select("slot", "K", F.col("_o.gene_ix").alias("idx"))


def fixed_panel_arrays(frozen: DataFrame, genes: DataFrame, design: Design) -> DataFrame:
    """The same frozen panel for every slot."""
    arrays = (
        frozen.join(genes, "gene")
        .groupBy("K")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "gene_ix"))).alias("_o"))
        .select("K", F.col("_o.gene_ix").alias("idx"))
    )
    slots = F.explode(F.sequence(F.lit(0), F.lit(design.n_slots - 1))).alias("slot")
    return arrays.select(slots, "K", "idx")


def all_features(n_features: int, design: Design, spark) -> DataFrame:
    """One cell per slot that uses every feature; K is 0."""
    return spark.range(design.n_slots).select(
        F.col("id").cast("int").alias("slot"),
        F.lit(0).alias("K"),
        F.sequence(F.lit(0), F.lit(n_features - 1)).alias("idx"),
    )


def nested_slots(folded: DataFrame, n_folds: int = N_FOLDS) -> DataFrame:
    """Roles of the inner cross-validation: one slot per (slot, fold)."""
    held = F.sequence(F.lit(0), F.lit(n_folds - 1))
    return folded.withColumns({
        "train": F.flatten(F.transform("fold", lambda f: F.transform(held, lambda h: (f >= 0) & (f != h)))),
        "test": F.flatten(F.transform("fold", lambda f: F.transform(held, lambda h: f == h))),
    }).drop("fold")


def nested_panels(panels: DataFrame, n_folds: int = N_FOLDS) -> DataFrame:
    """Panels of the inner slots: those of the slot they belong to."""
    inner = F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1)))
    return panels.select("*", inner.alias("_h")).withColumn(
        "slot", (F.col("slot") * n_folds + F.col("_h")).cast("int")
    ).drop("_h")


def cell_rows(roles: DataFrame, arrays: DataFrame, pos: str) -> DataFrame:
    """(slot, K, sample_ix, class, is_pos, in_train[, fold], x) for rows that play a part in the slot."""
    fields = {"train": "train"}
    if "test" in roles.columns:
        fields["test"] = "test"
    if "fold" in roles.columns:
        fields["fold"] = "fold"
    rows = roles.select(
        "sample_ix", "class", "features", F.posexplode_outer(F.arrays_zip(*fields)).alias("slot", "_r")
    )
    if "test" in fields:
        rows = rows.where("_r.train or _r.test")
    kept = [F.col("_r.fold").alias("fold")] if "fold" in fields else []
    features = F.col("features")
    return rows.join(arrays, "slot").select(
        "slot", "K", "sample_ix", "class", (F.col("class") == pos).alias("is_pos"),
        F.col("_r.train").alias("in_train"), *kept,
        F.transform("idx", lambda i: F.get(features, i)).alias("x"),
    )


def decided(scored: DataFrame, model: str, design: Design) -> DataFrame:
    """Predictions from `p_pos`; a tie goes to the class that sorts first."""
    wins = F.col("p_pos") >= 0.5 if design.pos < design.neg else F.col("p_pos") > 0.5
    return scored.select(
        F.lit(model).alias("model"), "slot", "K", "sample_ix", "class", "p_pos",
        F.when(wins, design.pos).otherwise(design.neg).alias("predicted"),
    )


def fold_rows(rows: DataFrame, n_folds: int = N_FOLDS) -> DataFrame:
    """Inner folds of training rows that include synthetic ones (id below zero, after all others)."""
    place = F.when(F.col("sample_ix") >= 0, F.col("sample_ix")).otherwise(F.lit(2**61) - F.col("sample_ix"))
    placed = numbered(
        rows.withColumn("_place", place), ["slot", "K", "class"], "_place", id_bucket(F.col("_place")), "_no"
    )
    groups = placed.groupBy("slot", "K", "class").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    lower = Window.partitionBy("slot", "K").orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("_lo", F.coalesce(F.sum("_n").over(lower), F.lit(0)))

    def below(m, i: int):
        return F.floor((m - i + n_folds - 1) / n_folds)

    upto, fold = F.lit(0).cast("long"), F.lit(0)
    for i in range(n_folds - 1):
        upto = upto + below(F.col("_lo") + F.col("_n"), i) - below(F.col("_lo"), i)
        fold = fold + (F.col("_no") > upto).cast("int")
    return placed.join(groups, ["slot", "K", "class"]).withColumn("fold", fold).drop("_place", "_no", "_n", "_first", "_lo")
