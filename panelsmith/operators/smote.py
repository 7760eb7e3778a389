"""Synthetic minority rows, interpolated between neighbours of the same class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelsmith.design import Design
from panelsmith.operators.neighbours import nearest, pack_blocks
from panelsmith.operators.ranking import id_bucket, numbered
from panelsmith.session import settle

# Neighbours considered at most, and the seed of the draws.
MAX_NEIGHBOURS = 5
DRAW_SEED = 1
_CHUNK = 4096


def _draw(key: Column, at: int) -> Column:
    """Ten hex digits of the draw key as an integer below 2^40."""
    return F.conv(F.substring(key, at, 10), 16, 10).cast("bigint")


def minority_plan(train: DataFrame) -> DataFrame:
    """(slot, K, is_pos, n_min, need, n_near): which class is short, by how much, and its neighbour count.

    Balanced cells and cells whose minority has fewer than two rows get none.
    """
    counts = train.groupBy("slot", "K").agg(
        F.count_if("is_pos").alias("n1"), F.count_if(~F.col("is_pos")).alias("n0")
    )
    n_min = F.least("n1", "n0")
    return counts.where((F.col("n1") != F.col("n0")) & (n_min >= 2)).select(
        "slot", "K", (F.col("n1") < F.col("n0")).alias("is_pos"), n_min.alias("n_min"),
        F.abs(F.col("n1") - F.col("n0")).alias("need"),
        F.least(F.lit(MAX_NEIGHBOURS), n_min - 1).alias("n_near"),
    )


def synthetic(train: DataFrame, design: Design, slots_per_split: int = 1) -> DataFrame:
    """(slot, K, j, base_ix, near_ix, u, x, class, is_pos): the rows that fill up the minority."""
    plan = settle(minority_plan(train), "smote-plan")
    minority = settle(
        numbered(
            train.join(plan.select("slot", "K", "is_pos"), ["slot", "K", "is_pos"]).select(
                "slot", "K", "sample_ix", "class", "is_pos", "x"
            ),
            ["slot", "K"], "sample_ix", id_bucket(F.col("sample_ix")), "base_no",
        ),
        "minority",
    )
    blocks = settle(pack_blocks(minority), "minority-blocks")
    near = nearest(blocks, blocks, MAX_NEIGHBOURS, same_rows=True).select(
        "slot", "K", F.col("sample_ix").alias("base_ix"), F.col("nth").cast("bigint").alias("nth"), "near_ix"
    )
    # two steps, so that a large need is neither one long array nor one task
    chunks = plan.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("need") - 1) / _CHUNK))).alias("c"))
    first = F.col("c") * _CHUNK + 1
    cores = train.sparkSession.sparkContext.defaultParallelism
    draws = chunks.repartition(cores, "slot", "K", "c").select(
        "slot", "K", "n_min", "n_near",
        F.explode(F.sequence(first, F.least(first + _CHUNK - 1, F.col("need")))).alias("j"),
    )
    outer = F.floor(F.col("slot") / slots_per_split)
    key = F.md5(F.concat_ws(
        "|", F.lit("smote"), F.lit(str(DRAW_SEED)), design.rep_of(outer).cast("string"),
        design.split_of(outer).cast("string"), (F.col("slot") % slots_per_split).cast("string"),
        F.col("K").cast("string"), F.col("j").cast("string"),
    ).cast("binary"))
    draws = draws.withColumn("_key", key).select(
        "slot", "K", "j",
        (_draw(F.col("_key"), 1) % F.col("n_min") + 1).alias("base_no"),
        (_draw(F.col("_key"), 11) % F.col("n_near") + 1).alias("nth"),
        (_draw(F.col("_key"), 21) / float(2**40)).alias("u"),
    )
    # stored: what comes out of an array is planned as if it were one row, and all draws would be sent through the driver
    draws = settle(draws, "smote-draws")
    base = minority.select("slot", "K", "base_no", F.col("sample_ix").alias("base_ix"), "class", "is_pos", "x")
    other = minority.select("slot", "K", F.col("sample_ix").alias("near_ix"), F.col("x").alias("near_x"))
    u = F.col("u")
    return (
        draws.join(base, ["slot", "K", "base_no"])
        .join(near, ["slot", "K", "base_ix", "nth"])
        .join(other, ["slot", "K", "near_ix"])
        .select(
            "slot", "K", "j", "base_ix", "near_ix", "u",
            F.zip_with("x", "near_x", lambda a, b: a + u * (b - a)).alias("x"), "class", "is_pos",
        )
    )


def oversampled(train: DataFrame, design: Design, slots_per_split: int = 1) -> DataFrame:
    """Training rows followed by their synthetic rows (ids below zero)."""
    columns = ["slot", "K", "sample_ix", "class", "is_pos", "x"]
    extra = synthetic(train, design, slots_per_split).withColumn("sample_ix", -F.col("j"))
    return train.select(*columns).unionByName(extra.select(*columns))
