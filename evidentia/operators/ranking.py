"""Ranks, caps and running numbers that stay distributed on hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.session import materialize


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """1-based rank per key, cut at ``k``.

    Spark turns the filter on ``row_number`` into a group limit that runs
    before the shuffle, so at most ``k`` rows per key and task travel.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key under ``order``."""
    return top_k(df, keys, order, 1, "_first").drop("_first")


def split_row_number(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    out: str = "row_no",
) -> DataFrame:
    """Exact 1-based row numbers per key without one task per key.

    ``bucket`` must not decrease along ``order`` (a day of the first sort
    column, say).  Rows are numbered inside (key, bucket), and the sizes of the
    earlier buckets of the key are added; only those sizes are ever brought
    together per key.
    """
    numbered = df.withColumn("_bucket", bucket)
    local = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    before = (
        Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    sizes = (
        numbered.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    return (
        numbered.withColumn("_local", F.row_number().over(local))
        .join(sizes, [*keys, "_bucket"])
        .withColumn(out, F.col("_local") + F.col("_offset"))
        .drop("_local", "_offset", "_bucket")
    )


def ranged_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "row_no") -> DataFrame:
    """Exact 1-based row numbers per key, whatever share of the rows one key has.

    The rows are dealt to ranges of (keys, order) by Spark's sampled range
    partitioner and written once with their range; a key of any size lies in as
    many ranges as it needs.  Numbers are counted inside the ranges and shifted.
    """
    ranges = df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_range", F.spark_partition_id())
    return split_row_number(materialize(ranges, "ranges"), keys, F.col("_range"), order, out).drop("_range")


def capped(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cap: int) -> DataFrame:
    """The first ``cap`` rows per key, each with a flag whether its key had more."""
    w = Window.partitionBy(*keys).orderBy(*order)
    kept = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap + 1)
    total = Window.partitionBy(*keys)
    return (
        kept.withColumn("truncated", F.max("_n").over(total) > cap)
        .where(F.col("_n") <= cap)
        .drop("_n")
    )
