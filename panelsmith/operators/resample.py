"""Stratified Monte-Carlo splits, inner folds and class weights.

A split is not stored as a list of rows. It is one cut value per (rep, split,
class): a sample is in the training part when its draw key is not above the
cut. Membership is then a narrow per-row expression, and re-used everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from panelsmith.design import Design, N_FOLDS
from panelsmith.operators.ranking import hash_bucket, id_bucket, order_statistics
from panelsmith.session import settle


def class_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def require_two_classes(samples: DataFrame) -> DataFrame:
    """Class counts, or an error when there is one class or a class of one sample."""
    counts = class_counts(samples)
    everything = Window.partitionBy(F.lit(1))
    return counts.withColumn(
        "n",
        F.when(
            (F.count(F.lit(1)).over(everything) >= 2) & (F.min("n").over(everything) >= 2),
            F.col("n"),
        ).otherwise(F.raise_error(F.lit("need at least two classes of at least two samples")).cast("long")),
    )


def train_quotas(counts: DataFrame, test_size: float) -> DataFrame:
    """Training rows per class: floor of the proportional share plus largest remainder."""
    everything = Window.partitionBy(F.lit(1))
    wide = F.col("n_train").cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)")
    by_remainder = everything.orderBy(F.desc("_rem"), "class")
    return (
        counts.withColumn("_all", F.sum("n").over(everything))
        .withColumn("n_train", F.col("_all") - F.ceil(F.lit(test_size) * F.col("_all")))
        .withColumn("_rem", (wide % F.col("_all").cast("decimal(19,0)")).cast("long"))
        .withColumn("_floor", ((wide - F.col("_rem")) / F.col("_all")).cast("long"))
        .withColumn("_left", F.col("n_train") - F.sum("_floor").over(everything))
        .withColumn("_bonus", (F.row_number().over(by_remainder) <= F.col("_left")).cast("long"))
        .select("class", "n", (F.col("_floor") + F.col("_bonus")).alias("quota"))
    )


def split_cuts(samples: DataFrame, design: Design) -> DataFrame:
    """(slot, class, quota, cut): the quota-th smallest draw key of each class and slot."""
    quotas = settle(train_quotas(require_two_classes(samples), design.test_size), "quotas")
    slots = F.explode(F.sequence(F.lit(0), F.lit(design.n_slots - 1))).alias("slot")
    rows = (
        samples.select("sample_ix", "class")
        .join(quotas, "class")
        .select("class", "n", "sample_ix", slots)
        .withColumn("draw", design.draw_key(F.col("slot"), F.col("sample_ix")))
        .withColumn("bucket", hash_bucket(F.col("draw"), F.col("n")))
    )
    wanted = quotas.select("class", "quota", F.col("quota").alias("rank"), slots)
    cuts = order_statistics(rows, wanted.drop("quota"), ["slot", "class"], "draw", "bucket")
    return settle(
        wanted.join(cuts.drop("rank"), ["slot", "class"], "left").select(
            "slot", "class", "quota", F.col("draw").alias("cut")
        ),
        "cuts",
    )


def with_roles(samples: DataFrame, cuts: DataFrame, design: Design) -> DataFrame:
    """Add `train`: per slot, whether the sample is in the training part."""
    by_class = cuts.groupBy("class").agg(
        F.array_sort(F.collect_list(F.struct("slot", F.coalesce("cut", F.lit("")).alias("cut")))).alias("_cuts")
    )
    sample_ix = F.col("sample_ix")
    return (
        samples.join(by_class, "class")
        .withColumn(
            "train", F.transform("_cuts", lambda c: design.draw_key(c.slot, sample_ix) <= c.cut)
        )
        .drop("_cuts")
    )


def by_slot(roles: DataFrame, *extra: str) -> DataFrame:
    """One row per (slot, sample): slot, in_train[, fold].

    The arrays are never empty; the outer form keeps the optimizer from adding a
    filter on their size, which would compute every draw key twice.
    """
    if "fold" in roles.columns:
        zipped = F.arrays_zip("train", "fold")
        picked = [F.col("_role.train").alias("in_train"), F.col("_role.fold").alias("fold")]
    else:
        zipped = F.col("train")
        picked = [F.col("_role").alias("in_train")]
    return roles.select("sample_ix", "class", *extra, F.posexplode_outer(zipped).alias("slot", "_role")).select(
        "slot", "sample_ix", "class", *extra, *picked
    )


def memberships(roles: DataFrame, design: Design) -> DataFrame:
    """(rep, split, sample_ix, class, role) for every sample and split."""
    return by_slot(roles).select(
        design.rep_of(F.col("slot")).alias("rep"),
        design.split_of(F.col("slot")).alias("split"),
        "sample_ix",
        "class",
        F.when(F.col("in_train"), "train").otherwise("test").alias("role"),
    )


def fold_ends(roles: DataFrame, n_folds: int = N_FOLDS) -> DataFrame:
    """Last sample of folds 0..n-2 for each (slot, class) of the training part.

    Training rows are laid out class after class (classes in the order of their
    first row); position p belongs to fold p mod n. A class hands its first
    rows, in source order, to fold 0, the next ones to fold 1, and so on.
    """
    rows = by_slot(roles).where("in_train").select("slot", "class", "sample_ix")
    groups = rows.groupBy("slot", "class").agg(
        F.count(F.lit(1)).alias("n"), F.min("sample_ix").alias("first_ix")
    )
    lower = Window.partitionBy("slot").orderBy("first_ix").rowsBetween(Window.unboundedPreceding, -1)
    groups = settle(
        groups.withColumn("lo", F.coalesce(F.sum("n").over(lower), F.lit(0))).withColumn(
            "hi", F.col("lo") + F.col("n")
        ),
        "fold-groups",
    )

    def below(m, i: int):
        return F.floor((m - i + n_folds - 1) / n_folds)

    cumulative = F.lit(0).cast("long")
    ends = []
    for i in range(n_folds - 1):
        cumulative = cumulative + below(F.col("hi"), i) - below(F.col("lo"), i)
        ends.append(F.struct(F.lit(i).alias("fold"), cumulative.alias("rank")))
    wanted = groups.select("slot", "class", F.inline(F.array(*ends)))
    rows = rows.withColumn("bucket", id_bucket(F.col("sample_ix")))
    found = order_statistics(
        rows, wanted.where("rank > 0").select("slot", "class", "rank").distinct(),
        ["slot", "class"], "sample_ix", "bucket",
    )
    return settle(
        wanted.join(found, ["slot", "class", "rank"], "left")
        .groupBy("slot", "class")
        .agg(F.array_sort(F.collect_list(F.struct("fold", F.coalesce("sample_ix", F.lit(-1)).alias("last")))).alias("ends"))
        .select("slot", "class", F.col("ends.last").alias("ends")),
        "fold-ends",
    )


def with_folds(roles: DataFrame, ends: DataFrame) -> DataFrame:
    """Add `fold`: per slot, the fold of a training sample, -1 for a test sample."""
    by_slot_map = F.map_from_entries(F.collect_list(F.struct("slot", "ends")))
    # a dense array per class: the lookup of a row is by position
    by_class = (
        ends.groupBy("class")
        .agg(by_slot_map.alias("_map"), F.max("slot").alias("_last"))
        .select("class", F.transform(F.sequence(F.lit(0), F.col("_last")), lambda i: F.try_element_at("_map", i)).alias("_ends"))
    )
    sample_ix = F.col("sample_ix")
    return (
        roles.join(by_class, "class", "left")
        .withColumn(
            "fold",
            F.transform(
                "train",
                lambda t, i: F.when(
                    t,
                    F.size(F.filter(F.get("_ends", i), lambda e: e < sample_ix)),
                ).otherwise(-1),
            ),
        )
        .drop("_ends")
    )


def balanced_weights(roles: DataFrame) -> DataFrame:
    """(slot, class, n, weight): training weight n / (classes * n_class)."""
    counts = by_slot(roles).where("in_train").groupBy("slot", "class").agg(F.count(F.lit(1)).alias("n"))
    slot = Window.partitionBy("slot")
    return counts.withColumn(
        "weight", F.sum("n").over(slot) / (F.count(F.lit(1)).over(slot) * F.col("n"))
    )
