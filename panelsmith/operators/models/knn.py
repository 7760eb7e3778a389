"""Nearest-neighbour vote, weighted by inverse distance, on features divided by their deviation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelsmith.design import Design
from panelsmith.operators.cells import decided
from panelsmith.operators.models.nb import population_moments
from panelsmith.operators.neighbours import nearest, pack_blocks
from panelsmith.session import settle

# Fixed value: neighbours that vote.
NEIGHBOURS = 3


def scales_from_fit(fit: DataFrame, panels: DataFrame) -> DataFrame:
    """(slot, K, scale): training deviations of the panel features, from the ranking's moments."""
    cells = panels.select("slot", "K", "rank", "gene_ix").join(
        population_moments(fit).select("slot", "gene_ix", "p"), ["slot", "gene_ix"]
    )
    return _as_scale(cells.select("slot", "K", "rank", F.sqrt("p").alias("dev")))


def scales_from_rows(train: DataFrame) -> DataFrame:
    """The same from the rows themselves, for training sets with synthetic rows."""
    exploded = train.select("slot", "K", F.posexplode("x").alias("rank", "v"))
    return _as_scale(exploded.groupBy("slot", "K", "rank").agg(F.stddev_pop("v").alias("dev")))


def _as_scale(devs: DataFrame) -> DataFrame:
    dev = F.when(F.col("dev") == 0, F.lit(1.0)).otherwise(F.col("dev"))
    return (
        devs.select("slot", "K", F.struct("rank", dev.alias("dev")).alias("_s"))
        .groupBy("slot", "K")
        .agg(F.array_sort(F.collect_list("_s")).alias("_s"))
        .select("slot", "K", F.col("_s.dev").alias("scale"))
    )


def scaled(rows: DataFrame, scales: DataFrame) -> DataFrame:
    return rows.join(scales, ["slot", "K"]).withColumn(
        "x", F.zip_with("x", "scale", lambda v, s: v / s)
    ).drop("scale")


def votes(neighbours: DataFrame) -> DataFrame:
    """p_pos per query row: inverse-distance vote; rows at distance 0 outvote all others."""
    distance = F.sqrt("d2")
    by_row = neighbours.groupBy("slot", "K", "sample_ix").agg(
        F.sum(F.when((F.col("d2") == 0) & F.col("near_pos"), 1.0).otherwise(0.0)).alias("zero_pos"),
        F.sum(F.when(F.col("d2") == 0, 1.0).otherwise(0.0)).alias("zero"),
        F.sum(F.when((F.col("d2") > 0) & F.col("near_pos"), 1 / distance).otherwise(0.0)).alias("w_pos"),
        F.sum(F.when(F.col("d2") > 0, 1 / distance).otherwise(0.0)).alias("w"),
    )
    p = F.when(F.col("zero") > 0, F.try_divide("zero_pos", "zero")).otherwise(F.try_divide("w_pos", "w"))
    return by_row.select("slot", "K", "sample_ix", p.alias("p_pos"))


def predict(train: DataFrame, test: DataFrame, scales: DataFrame, design: Design, name: str = "kNN") -> DataFrame:
    """Score test cell rows by their nearest scaled training rows of the same cell."""
    t = pack_blocks(scaled(train, scales))
    q = settle(pack_blocks(scaled(test, scales)), "knn-query")
    scored = votes(nearest(q, t, NEIGHBOURS))
    labels = test.select("slot", "K", "sample_ix", "class")
    return decided(scored.join(labels, ["slot", "K", "sample_ix"]), name, design)
