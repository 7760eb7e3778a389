"""Readers for the table layouts at the edges: CSV/TSV matrices, tagged file families, panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from panelsmith.operators import clean
from panelsmith.operators.ranking import numbered

# Class by row position for the two published sizes of the leukemia set.
LEUKEMIA_RUNS = {
    38: [(27, "ALL"), (11, "AML")],
    72: [(27, "ALL"), (11, "AML"), (20, "ALL"), (14, "AML")],
}


def matching_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths (files or table folders) that match a glob, sorted."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(path)
    return sorted(s.getPath().toString() for s in found) if found else []


def with_row_number(df: DataFrame, name: str = "_row") -> DataFrame:
    """1-based row number in source order (file, block, position), without a global sort."""
    placed = df.select(
        "*",
        F.struct(
            F.col("_metadata.file_path").alias("f"),
            F.col("_metadata.file_block_start").alias("b"),
            F.monotonically_increasing_id().alias("i"),
        ).alias("_order"),
    )
    bucket = F.struct(F.col("_order.f"), F.col("_order.b"), F.shiftright(F.col("_order.i"), 16).alias("c"))
    return numbered(placed, [], "_order", bucket, name).drop("_order")


def read_csv(spark: SparkSession, path: str, sep: str = ",", header: bool = True) -> DataFrame:
    """Text columns as they are; an empty table is an error."""
    df = spark.read.csv(path, sep=sep, header=header, inferSchema=False)
    if not df.columns or df.isEmpty():
        raise ValueError(f"{path} is empty or not a table")
    return df


def _first_ids(names: Sequence[str]) -> list[tuple[int, str, str]]:
    """(new position, feature id, column) keeping the first column of each id."""
    seen: dict[str, str] = {}
    for n in names:
        seen.setdefault(clean.feature_id_name(n), n)
    return [(i, gene, column) for i, (gene, column) in enumerate(seen.items())]


def _gene_table(spark: SparkSession, kept: list[tuple[int, str, str]]) -> DataFrame:
    return spark.createDataFrame([(i, g) for i, g, _ in kept], "gene_ix int, gene string")


def _vector(columns: Sequence[str]) -> Column:
    return F.array(*[F.col(f"`{c}`").cast("double") for c in columns])


def read_grouped(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """One row per sample with a label column: samples and genes."""
    df = read_csv(spark, path)
    label, sample, features = clean.matrix_columns(df.columns)
    if label is None:
        raise ValueError(f"{path} has no group or label column")
    kept = _first_ids(features)
    samples = with_row_number(df).select(
        F.col("_row").alias("sample_ix"),
        F.col(f"`{sample}`").alias("sample_id"),
        clean.group_label(F.col(f"`{label}`")).alias("class"),
        _vector([c for _, _, c in kept]).alias("features"),
    )
    return samples, _gene_table(spark, kept)


def read_positional(
    spark: SparkSession, path: str, runs: Sequence[tuple[int, str]] | None = None
) -> tuple[DataFrame, DataFrame]:
    """One row per sample, no label column: class by row position, from runs of equal class."""
    df = read_csv(spark, path)
    if runs is None:
        n = df.count()
        if n not in LEUKEMIA_RUNS:
            raise ValueError(f"no labels known for {n} samples")
        runs = LEUKEMIA_RUNS[n]
    kept = _first_ids(df.columns)
    label, upto = None, 0
    for size, name in runs:
        upto += size
        step = F.col("_row") <= upto
        label = F.when(step, name) if label is None else label.when(step, name)
    too_many = F.raise_error(F.lit("more samples than labels"))
    samples = with_row_number(df).select(
        F.col("_row").alias("sample_ix"),
        F.concat(F.lit("sample_"), F.col("_row").cast("string")).alias("sample_id"),
        label.otherwise(too_many).alias("class"),
        _vector([c for _, _, c in kept]).alias("features"),
    )
    return samples, _gene_table(spark, kept)


def read_named_samples(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Features as rows, samples as columns, class from the sample name in the first row.

    Column 0 is not used; the feature id is the row number.
    """
    raw = with_row_number(read_csv(spark, path, header=False))
    names = raw.where("_row = 1")
    columns = [c for c in raw.columns if c != "_row"][1:]
    position = {c: i for i, c in enumerate(columns)}

    def melt(df: DataFrame, value: str) -> DataFrame:
        return df.unpivot("_row", columns, "_c", value)

    ix = F.replace(F.col("_c"), F.lit("_c"), F.lit("")).cast("long") - int(columns[0][2:])
    cells = melt(raw.where("_row > 1"), "value").select(
        ix.alias("sample_ix"), (F.col("_row") - 2).cast("int").alias("gene_ix"), F.col("value").cast("double").alias("value")
    )
    genes = raw.where("_row > 1").select(
        (F.col("_row") - 2).cast("int").alias("gene_ix"),
        clean.feature_id((F.col("_row") - 1).cast("string")).alias("gene"),
    )
    vectors = cells.groupBy("sample_ix").agg(
        F.array_sort(F.collect_list(F.struct("gene_ix", "value"))).alias("_o")
    )
    named = melt(names, "sample_id").select(ix.alias("sample_ix"), "sample_id")
    samples = vectors.join(named, "sample_ix").select(
        "sample_ix", "sample_id", clean.name_label(F.col("sample_id")).alias("class"),
        F.col("_o.value").alias("features"),
    )
    assert len(position) == len(columns)
    return samples, genes


def read_matrix(spark: SparkSession, path: str, dataset: str = "") -> tuple[DataFrame, DataFrame]:
    """Choose the layout: by the positional data set's name, then by a label header, else named samples."""
    if dataset.lower() == "golub":
        return read_positional(spark, path)
    label, _, _ = clean.matrix_columns(spark.read.csv(path, header=True).columns)
    return read_grouped(spark, path) if label is not None else read_named_samples(spark, path)


# --- tagged families ------------------------------------------------------------------------


def read_family(
    spark: SparkSession, pattern: str, tag: Column, name: str, schema: str | None = None, sep: str = "\t"
) -> DataFrame:
    """All tables that match a glob, with a key taken from their path.

    Tables are grouped by header and read once per header: one read over files
    of different headers would silently use the first file's names. No match
    is an error, or an empty table when a schema is given.
    """
    paths = matching_paths(spark, pattern)
    if not paths:
        if schema is None:
            raise FileNotFoundError(f"nothing matches {pattern}")
        return spark.createDataFrame([], schema)
    by_header: dict[tuple[str, ...], list[str]] = {}
    for p in paths:
        by_header.setdefault(tuple(spark.read.csv(p, sep=sep, header=True).columns), []).append(p)
    parts = [
        spark.read.csv(group, sep=sep, header=True, inferSchema=True).withColumn(name, tag)
        for group in by_header.values()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def panel_size_tag() -> Column:
    """K from `…_k<K>.tsv` in the path; a path without it is an error."""
    k = F.regexp_extract(F.col("_metadata.file_path"), r"_k(\d+)\.tsv", 1)
    bad = F.raise_error(F.concat(F.lit("no K in "), F.col("_metadata.file_path"))).cast("int")
    return F.when(k != "", k.try_cast("int")).otherwise(bad)


def cores_tag() -> Column:
    """Core count from `cores<N>` in the path; null for `coresNA`."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"/cores(\d+|NA)", 1).try_cast("int")


def read_k_family(spark: SparkSession, pattern: str, schema: str | None = None) -> DataFrame:
    return read_family(spark, pattern, panel_size_tag(), "K", schema)


def read_cores_family(spark: SparkSession, pattern: str, schema: str | None = None) -> DataFrame:
    return read_family(spark, pattern, cores_tag(), "cores", schema)


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """(file, rank, gene) from panel text files; blank lines are ignored, line order is rank."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("_at"),
        F.trim("value").alias("gene"),
    )
    order = Window.partitionBy("file").orderBy("_at")
    return lines.where("gene <> ''").select("file", F.row_number().over(order).alias("rank"), "gene")


def read_job_seconds(spark: SparkSession, path: str) -> DataFrame:
    """(file, seconds): second field of the first data row of each job timing file."""
    df = spark.read.csv(path, sep="\t", header=True)
    second = df.columns[1]
    placed = df.select(
        F.col("_metadata.file_path").alias("file"), F.col(f"`{second}`").alias("text"),
        F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("at"),
    )
    return placed.groupBy("file").agg(F.min_by("text", "at").alias("text")).select(
        "file", clean.duration_seconds(F.col("text")).alias("seconds")
    )


def read_or_empty(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    """A table, or no rows when the file is missing or empty."""
    if not matching_paths(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).csv(path, sep=sep, header=True)
