"""Choosing one row per key with explicit ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_best(df: DataFrame, keys: list[str], *best: Column) -> DataFrame:
    """One row per key, the first in the order given.

    An aggregate with partial maxima cannot serve arbitrary orders, so rows of a key
    meet in one window; use `best_by` for large groups.
    """
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).filter("_n = 1").drop("_n")


def best_by(df: DataFrame, keys: list[str], *largest: Column) -> DataFrame:
    """One row per key: the one with the largest struct of `largest`. Partial maxima keep hot keys cheap."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(*largest)).alias("_r")).select("_r.*")


def keep_first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """First row per key by `order`; rows with a blank key all stay."""
    blank = F.coalesce(F.trim(F.col(key)), F.lit("")) == ""
    return best_by(df.filter(~blank), [key], -F.col(order)).unionByName(df.filter(blank))


def mode_first_seen(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """keys, mode, n: the most frequent value per key; ties go to the value seen first."""
    seen = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = F.max(F.struct("n", (-F.col("first")).alias("early"), F.col(value).alias("value")))
    return seen.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.value").alias("mode"), F.col("b.n").alias("n"))
