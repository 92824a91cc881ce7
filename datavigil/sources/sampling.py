"""Repeatable samples: a row is chosen by a hash of its key, so a rerun or a lost task picks the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _hash(key: list[str], seed: int) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))


def _unit(key: list[str], seed: int) -> Column:
    """A number in [0, 1) from the first eight hex digits of the hash."""
    return F.conv(F.substring(_hash(key, seed), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def sample_bernoulli(df: DataFrame, fraction: float, key: list[str], seed: int = 0, limit: int | None = None):
    """Each row with the same chance; narrow. `limit` then keeps the rows with the smallest hash."""
    rows = df.filter(_unit(key, seed) < fraction)
    return rows if limit is None else rows.orderBy(_hash(key, seed), *key).limit(limit)


def sample_topn(df: DataFrame, n: int, key: list[str], seed: int = 0) -> DataFrame:
    """n random rows: a top-k by hash, so every task sends n rows at most."""
    return df.orderBy(_hash(key, seed), *key).limit(n)


def sample_k(df: DataFrame, k: int, by: list[str], key: list[str], seed: int = 0) -> DataFrame:
    """k random rows per group. Spark cuts every group to k rows in each task before it shuffles, so a hot group is
    never sent or sorted whole."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy("_hash", *key))
    return df.withColumn("_hash", _hash(key, seed)).withColumn("_rank", rank).filter(F.col("_rank") <= k).drop(
        "_hash", "_rank")
