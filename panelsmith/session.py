"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "panelsmith", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators are written for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # grouped vector sums use object aggregation; keep them hash based
        "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "100000",
        # wide rows: bound Arrow batches by bytes rather than by rows alone
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_scratch: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's checkpoint folder.

    Only a local-mode session without one falls back to a fresh temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _local_scratch[app]


#: Rows of a piece of a table that is known to be small.
PIECE_ROWS = 10_000


def settle(df: DataFrame, name: str, *partition_by: str, rows: int | None = None) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    The written table ends the lineage, survives lost executors, and has a
    known size, so the optimizer itself decides whether it is small enough to
    broadcast; no join in this package forces a broadcast.

    `rows`, if given, is about how many rows the last stage reads: a table made
    of few is written in fewer pieces than the shuffle has partitions, one per
    core at least. Every file costs a task and, on a local disk, a process of
    the executor that sets its mode.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, 1 + rows // PIECE_ROWS))
    path = os.path.join(shared_folder(spark), "panelsmith", f"{name}-{uuid.uuid4().hex}")
    schema = df.schema
    df.write.partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.settled_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that `settle` returned, once what was made of them is written itself; nothing may read them later."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.settled_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, name: str) -> DataFrame:
    """A stored table in at least one piece per core.

    A table that already comes in enough pieces is left as it is. One that does
    not is small (fewer than `cores` file splits) and is written out once in
    even pieces. Call this on a plain scan: it looks at the partitions.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return settle(df.repartition(cores), name)
