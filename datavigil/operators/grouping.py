"""Shared ways to pick rows per key that combine on the map side, so that a hot key never lands whole in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_BOTH_ENDS = (W.unboundedPreceding, W.unboundedFollowing)


def pick_latest(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The row with the greatest `order` per key. An aggregate, so each task sends one row per key."""
    return _pick(df, keys, F.max_by, order)


def pick_first(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The row with the smallest `order` per key."""
    return _pick(df, keys, F.min_by, order)


def _pick(df, keys, by, order):
    rest = [c for c in df.columns if c not in keys]
    best = by(F.struct(*[F.col(c) for c in rest]), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("_best")[c].alias(c) for c in rest]).select(*df.columns)


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Natural-key upsert: the row with the newest `version` wins; on a tie the change wins."""
    both = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return pick_latest(both, keys, F.col(version), F.col("_new")).drop("_new")


def earlier_count(df: DataFrame, keys: list[str], bucket: Column, *order: Column | str, name: str) -> DataFrame:
    """Number of earlier rows with the same key, without sorting a whole key in one task.

    Rows are counted per (key, bucket), the counts are summed over earlier buckets, and only the place inside one
    bucket is a row number. `bucket` must grow with `order` (a day or scan of the ordering time stamp).
    """
    marked = df.withColumn("_bucket", bucket)
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        marked.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        marked.join(offsets, [*keys, "_bucket"])
        .withColumn(name, F.col("_before") + F.row_number().over(inside) - 1)
        .drop("_bucket", "_before")
    )


def page(df: DataFrame, order: list, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Sorted page of a list, which Spark runs as a top-k; without a limit the whole list, sorted by ranges."""
    out = df.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def share_of_total(df: DataFrame, count_col: str, name: str) -> DataFrame:
    """Percentage of the summed count, over an already aggregated (small) frame."""
    total = df.select(F.sum(count_col).alias("t")).scalar()
    return df.withColumn(name, F.col(count_col) / total * 100)


def exact_avg(col: str) -> Column:
    """Mean of a score to nine decimals, added up as decimals: partitions may be summed in any order."""
    return F.sum(F.col(col).cast("decimal(18,9)")).cast("double") / F.count(col)
