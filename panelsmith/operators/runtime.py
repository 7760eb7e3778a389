"""Runtime tables: per core count, totals, wall clock and speed-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def per_core(metrics: DataFrame) -> DataFrame:
    """Mean and total train/predict seconds per (model, K, cores)."""
    return metrics.groupBy("model", "K", "cores").agg(
        F.avg("train_s").alias("Train_mean"),
        F.avg("pred_s").alias("Pred_mean"),
        F.sum("train_s").alias("Train_total"),
        F.sum("pred_s").alias("Pred_total"),
    )


def merged(summaries: DataFrame) -> DataFrame:
    """Per-core summaries in reading order."""
    return summaries.orderBy("model", "cores", "K")


def with_runtime_total(summaries: DataFrame) -> DataFrame:
    return summaries.withColumn("Runtime_total", F.col("Train_total") + F.col("Pred_total"))


def wall_clock(jobs: DataFrame) -> DataFrame:
    """Wall clock of a core count: the slowest of its jobs (cores, seconds)."""
    return jobs.groupBy("cores").agg(F.max("seconds").alias("wall_clock_s"))


def speed_up(clock: DataFrame) -> DataFrame:
    """Seconds at the smallest known core count over seconds; null when that base is not positive."""
    base = clock.where("cores is not null").select(F.min_by("wall_clock_s", "cores").alias("b")).scalar()
    return clock.select(
        "cores", "wall_clock_s",
        F.when(base > 0, F.try_divide(base, F.col("wall_clock_s"))).alias("speed_up"),
    )


def totals(summaries: DataFrame) -> DataFrame:
    """Train and predict totals per (model, cores); null when every value is null."""
    return summaries.groupBy("model", "cores").agg(
        F.sum("Train_total").alias("Train_total"), F.sum("Pred_total").alias("Pred_total")
    )


def representative(summaries: DataFrame) -> DataFrame:
    """The rows of the largest core count, for curves over K."""
    largest = summaries.select(F.max("cores")).scalar()
    return summaries.where(F.col("cores") == largest).drop("cores")


def metric_by_cores(summaries: DataFrame, metric: str) -> DataFrame:
    """Mean and sample deviation of a metric per (cores, model)."""
    return summaries.groupBy("cores", "model").agg(
        F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("sd")
    )
