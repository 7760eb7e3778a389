"""Exact order statistics and dense numbering without one big sorted group.

A window over a whole group sorts that group in one task. Here each row first
falls into a bucket that is monotone in the sort key; bucket sizes are
pre-aggregated, and only rows of the few buckets that hold a wanted rank are
sorted. Results are the same as with `row_number()` over the whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelsmith.session import settle

# Rows of one bucket are sorted in one task; ids are dense, so this bounds it.
ID_BUCKET = 65_536


def id_bucket(ix: Column) -> Column:
    return F.floor(ix / ID_BUCKET)


def hash_bucket(key: Column, group_size: Column, per_bucket: int = 4_096) -> Column:
    """Leading hex digits of a uniform hash, enough for about `per_bucket` rows each."""
    digits = F.greatest(
        F.lit(1), F.ceil(F.log(group_size / per_bucket) / F.log(F.lit(16.0))).cast("int")
    )
    return F.substring(key, F.lit(1), digits)


def order_statistics(
    rows: DataFrame, wanted: DataFrame, keys: Sequence[str], value: str, bucket: str, copies: str | None = None
) -> DataFrame:
    """`value` at 1-based `rank` (a column of `wanted`) within each key group.

    With `copies`, a row stands for that many equal values.
    """
    keys = list(keys)
    rows = rows.select(*keys, bucket, value, (F.col(copies) if copies else F.lit(1)).cast("bigint").alias("_copies"))
    sizes = rows.groupBy(*keys, bucket).agg(F.sum("_copies").alias("_size"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    sizes = sizes.withColumn("_upto", F.sum("_size").over(before))
    hits = (
        wanted.join(sizes, keys)
        .where((F.col("rank") <= F.col("_upto")) & (F.col("rank") > F.col("_upto") - F.col("_size")))
        .select(*keys, bucket, "rank", (F.col("rank") - F.col("_upto") + F.col("_size")).alias("_at"))
    )
    within = Window.partitionBy(*keys, bucket).orderBy(value).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    placed = rows.join(hits.select(*keys, bucket).distinct(), [*keys, bucket], "left_semi").withColumn(
        "_end", F.sum("_copies").over(within)
    )
    return (
        placed.join(hits, [*keys, bucket])
        .where((F.col("_at") <= F.col("_end")) & (F.col("_at") > F.col("_end") - F.col("_copies")))
        .select(*keys, "rank", value)
    )


def numbered(rows: DataFrame, keys: Sequence[str], order: str, bucket: Column, name: str) -> DataFrame:
    """Dense 1-based row number per key group in the order of `order` (unique per group)."""
    keys = list(keys)
    rows = rows.withColumn("_bucket", bucket)
    sizes = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    window = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("_bucket")
    offsets = sizes.select(
        *keys, "_bucket",
        F.coalesce(
            F.sum("_size").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_offset"),
    )
    within = Window.partitionBy(*keys, "_bucket").orderBy(order)
    return (
        rows.withColumn("_at", F.row_number().over(within))
        .join(offsets, [*keys, "_bucket"])
        .withColumn(name, (F.col("_offset") + F.col("_at")).cast("long"))
        .drop("_bucket", "_offset", "_at")
    )


# Equal-width buckets of the value range when quantiles are sought.
VALUE_BUCKETS = 4_096


def count_quantiles(
    rows: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Linear-interpolation quantiles per key.

    Equal values are merged before the shuffle, and the wanted ranks are looked
    up through buckets of the value range, so a group that holds most rows is
    neither moved whole nor sorted in one task.
    """
    keys = list(keys)
    counts = settle(
        rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")), "value-counts"
    )
    groups = settle(
        counts.groupBy(*keys).agg(F.sum("_n").alias("n"), F.min(value).alias("_lo"), F.max(value).alias("_hi")), "value-groups"
    )
    share = F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    placed = counts.join(groups, keys).withColumn("_bucket", F.floor(F.coalesce(share, F.lit(0.0)) * VALUE_BUCKETS))

    def at(p: float) -> Column:
        return F.lit(p) * (F.col("n") - 1)

    ranks = F.array_distinct(F.array(*[
        side(at(p)).cast("bigint") + 1 for p in probs.values() for side in (F.floor, F.ceil)
    ]))
    wanted = groups.select(*keys, F.explode(ranks).alias("rank"))
    found = order_statistics(placed, wanted, keys, value, "_bucket", "_n").groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("rank", value))).alias("_v")
    )
    out = []
    for name, p in probs.items():
        lo, hi = (F.element_at("_v", side(at(p)).cast("bigint") + 1) for side in (F.floor, F.ceil))
        out.append((lo + (at(p) - F.floor(at(p))) * (hi - lo)).alias(name))
    return groups.join(found, keys).select(*keys, "n", *out)
