"""The driver tables as samples and genes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

LABEL_RULES = {
    # balanced, imbalanced, planted signal
    "balanced": lambda: F.col("label") >= 5,
    "imbalanced": lambda: F.col("label") == 0,
    "planted": lambda: (
        F.col("embedding")[0].cast("double")
        + F.col("embedding")[1].cast("double")
        + 0.5 * F.col("embedding")[2].cast("double")
    ) > 0,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_samples(spark: SparkSession, sf_dir: str, rule: str = "balanced") -> DataFrame:
    """samples(sample_ix, sample_id, class, features) from the embeddings table."""
    positive: Column = LABEL_RULES[rule]()
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sample_ix"),
        F.concat(F.lit("s"), F.col("vec_id").cast("string")).alias("sample_id"),
        F.when(positive, "Cancer").otherwise("Control").alias("class"),
        F.col("embedding").cast("array<double>").alias("features"),
    )


def embedding_genes(samples: DataFrame) -> DataFrame:
    """genes(gene_ix, gene): names g0, g1, … for the positions of the feature vector."""
    width = samples.select(F.size("features").alias("n")).limit(1)
    return width.select(F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("gene_ix")).select(
        "gene_ix", F.concat(F.lit("g"), F.col("gene_ix").cast("string")).alias("gene")
    )


def feature_count(samples: DataFrame) -> int:
    return samples.select(F.size("features").alias("n")).first()["n"]


def long_matrix(samples: DataFrame, genes: DataFrame) -> DataFrame:
    """expr(sample_ix, sample_id, gene, gene_ix, value), one row per cell."""
    cells = samples.select("sample_ix", "sample_id", F.posexplode("features").alias("gene_ix", "value"))
    return cells.join(genes, "gene_ix").select("sample_ix", "sample_id", "gene", "gene_ix", "value")
