"""Constraints as reports: rows that break a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children with a key that no parent has; a null key is no orphan."""
    return children.filter(F.col(child_key).isNotNull()).join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand in more than one row, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, n: rows for which a rule is false. A null outcome passes, as in SQL checks. One pass for all rules."""
    counts = df.agg(*[F.sum(F.coalesce((~r).cast("long"), F.lit(0))).alias(k) for k, r in rules.items()])
    return counts.unpivot([], list(rules), "rule", "n").withColumn("n", F.coalesce("n", F.lit(0)))


def cascade(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """ON DELETE CASCADE."""
    return children.join(deleted.select(key).distinct(), key, "left_anti").select(*children.columns)


def set_null(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """ON DELETE SET NULL."""
    gone = deleted.select(F.col(key).alias("_gone")).distinct()
    return children.join(gone, F.col(key) == F.col("_gone"), "left").select(*[F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c == key else F.col(c) for c in children.columns])


def restricted(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """ON DELETE RESTRICT: the children that forbid the deletion; it may go on if there are none."""
    return children.join(deleted.select(key).distinct(), key, "left_semi")
