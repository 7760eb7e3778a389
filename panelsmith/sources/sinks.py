"""Writers: Parquet inside, text at the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_table(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def write_panels(panels: DataFrame, path: str) -> None:
    """Panels as text, one gene per line in rank order, one folder per K.

    A panel is one file: it has at most K lines.
    """
    lines = panels.repartition("K").sortWithinPartitions("K", "rank")
    lines.select("K", F.col("gene").cast("string").alias("value")).write.mode("overwrite").partitionBy("K").text(path)


def write_panel_counts(panels: DataFrame, path: str) -> None:
    """`gene<TAB>count` lines in rank order, one folder per K."""
    lines = panels.repartition("K").sortWithinPartitions("K", "rank")
    lines.select("K", "gene", "count").write.mode("overwrite").partitionBy("K").csv(path, sep="\t")


def write_tagged(df: DataFrame, path: str, run_tag: str) -> None:
    """The same table under a run tag, as a partition."""
    df.withColumn("run_tag", F.lit(run_tag)).write.mode("append").partitionBy("run_tag").parquet(path)
