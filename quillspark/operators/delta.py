"""Changes to a table as snapshot -> snapshot transformations.

Parquet has no UPDATE; each function returns the new snapshot. Applying the same
change twice gives the same rows as once, but for `toggled`, which takes itself back, and for
rows with a null key, which `upsert` and `insert_if_absent` append each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.validate import violations


def update_where(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """Set columns where the condition is true (null counts as false)."""
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def merge(df: DataFrame, updates: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """Apply `updates` to matching rows. Of several updates with one key the largest row counts, so rows never multiply.

    Rule per column: "overwrite" (blank becomes null), "prefer_new" (blank keeps the
    old value) or "fill" (only where the old value is blank). Other columns stay.
    """
    one = updates.groupBy(F.col(key).alias("_k")).agg(F.max(F.struct(*rules)).alias("_n"))
    new = one.select("_k", F.lit(True).alias("_hit"), *[F.col(f"_n.{c}").alias(f"_n_{c}") for c in rules])
    both = df.join(new, F.col(key) == F.col("_k"), "left")
    blank = lambda c: F.when(F.trim(F.col(c).cast("string")) != "", F.col(c))
    value = {
        "overwrite": lambda c: F.when(F.col("_hit"), blank(f"_n_{c}")).otherwise(F.col(c)),
        "prefer_new": lambda c: F.coalesce(blank(f"_n_{c}"), F.col(c)),
        "fill": lambda c: F.coalesce(blank(c), F.col(f"_n_{c}"), F.col(c)),
    }
    return both.select(*[value[rules[c]](c).alias(c) if c in rules else F.col(c) for c in df.columns])


def upsert(df: DataFrame, rows: DataFrame, key: str, update: list[str]) -> DataFrame:
    """Update the named columns of matching rows, append the rest, one row per key. Rows with a null key are all appended."""
    inserted = rows.join(df.select(key), key, "left_anti").select(*df.columns)
    largest = inserted.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*[c for c in df.columns if c != key])).alias("_r")).select(key, "_r.*")
    fresh = largest.select(*df.columns).unionByName(inserted.filter(F.col(key).isNull()))
    return merge(df, rows, key, dict.fromkeys(update, "overwrite")).unionByName(fresh)


def insert_if_absent(df: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Append rows whose keys the table does not hold."""
    return df.unionByName(rows.join(df.select(*keys).distinct(), keys, "left_anti").select(*df.columns))


def replace_children(df: DataFrame, parents: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Drop the children of the listed parents and append the new ones."""
    return df.join(parents.select(key).distinct(), key, "left_anti").select(*df.columns).unionByName(rows.select(*df.columns))


def delete_in(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Drop rows whose key is listed."""
    return df.join(keys.select(key), key, "left_anti").select(*df.columns)


def update_from_children(df: DataFrame, key: str, column: str, children: DataFrame, child_key: str, value: Column) -> DataFrame:
    """Set a column to an aggregate of child rows, 0 without children: a scalar subquery made explicit."""
    found = children.groupBy(F.col(child_key).alias("_k")).agg(value.alias("_v"))
    return df.join(found, F.col(key) == F.col("_k"), "left").select(*[F.coalesce("_v", F.lit(0)).alias(c) if c == column else F.col(c) for c in df.columns])


def normalised_where_changed(df: DataFrame, column: str, normal: Column) -> DataFrame:
    """Replace a column by its normal form where that is neither empty nor the same."""
    return df.withColumn(column, F.when((normal != "") & (normal != F.col(column)), normal).otherwise(F.col(column)))


def rebuild(df: DataFrame, columns: list[str], rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(copy by position into a table with other column names, how many of its rows break each rule)."""
    copied = df.toDF(*columns)
    return copied, violations(copied, rules)


def drop_column(df: DataFrame, name: str) -> DataFrame:
    """Without a column; one that is not there is an error, as for a table."""
    if name not in df.columns:
        raise KeyError(f"no column {name}")
    return df.drop(name)


def add_column(df: DataFrame, name: str, default: Column) -> DataFrame:
    return df.withColumn(name, default)


def split_dimension(df: DataFrame, columns: list[str], prefix: str) -> tuple[DataFrame, DataFrame]:
    """(facts with an id, dimension): the columns move into a table of their distinct values."""
    from quillspark.functions.scalars import stable_id

    with_id = df.withColumn(f"{prefix}_id", stable_id(prefix, *[F.col(c) for c in columns]))
    dimension = with_id.select(F.col(f"{prefix}_id").alias("id"), *columns).distinct()
    return with_id.drop(*columns), dimension


def toggled(selected: DataFrame, clicked: DataFrame) -> DataFrame:
    """Symmetric difference: clicked rows switch between selected and not."""
    return selected.exceptAll(clicked).unionByName(clicked.exceptAll(selected))
