"""What changed between two snapshots of a table, as rows that can be replayed.

Rows are compared as wholes, with their number, in one dealt aggregation; a row that many hold costs no more than one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _counted(df: DataFrame, columns: list[str], n: Column) -> DataFrame:
    return df.select(F.struct(*[F.col(c) for c in columns]).alias("row"), n.cast("long").alias("n"))


def difference(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """action ('insert', 'delete', 'update'), the key columns, before, after (whole rows), times: how to come from `old` to `new`.

    Both have the same columns; repeated rows count. A key with one row gone and one row come is an update, with both
    images; else what is gone is deleted and what has come is inserted, `times` times each. Null keys are keys like
    others, and nulls are equal. Rows that stay are not listed. Columns of type map cannot be compared.
    """
    columns = old.columns
    both = _counted(old, columns, F.lit(-1)).unionByName(_counted(new.select(*columns), columns, F.lit(1)))
    changed = both.groupBy("row").agg(F.sum("n").alias("n")).filter("n <> 0")
    key = F.struct(*[F.col("row")[k].alias(k) for k in keys])
    marked = changed.withColumn("key", key)
    # Of a key with one row on each side both images are maxima, so a hot key is summed up in every task first.
    gone, come = F.col("n") < 0, F.col("n") > 0
    paired = marked.groupBy("key").agg(F.sum(F.when(gone, -F.col("n")).otherwise(0)).alias("_gone"), F.sum(F.when(come, F.col("n")).otherwise(0)).alias("_come"), F.max(F.when(gone, F.col("row"))).alias("before"), F.max(F.when(come, F.col("row"))).alias("after"))
    one = (F.col("_gone") == 1) & (F.col("_come") == 1)
    none = F.lit(None).cast(changed.schema["row"].dataType)
    updates = paired.filter(one).select(F.lit("update").alias("action"), "key.*", "before", "after", F.lit(1).cast("long").alias("times"))
    single = paired.filter(one).select(F.col("key").alias("_key"))
    rest = marked.join(single, F.col("key").eqNullSafe(F.col("_key")), "left_anti")
    others = rest.select(F.when(gone, "delete").otherwise("insert").alias("action"), "key.*", F.when(gone, F.col("row")).otherwise(none).alias("before"), F.when(come, F.col("row")).otherwise(none).alias("after"), F.abs("n").alias("times"))
    return updates.unionByName(others)


def replayed(old: DataFrame, changes: DataFrame) -> DataFrame:
    """The snapshot after the changes: replayed(old, difference(old, new, keys)) has the rows of `new`, each as often. Changes that `old` does not fit raise an error."""
    columns = old.columns
    come = changes.filter("after IS NOT NULL").select(F.col("after").alias("row"), F.col("times").alias("n"))
    gone = changes.filter("before IS NOT NULL").select(F.col("before").alias("row"), (-F.col("times")).alias("n"))
    left = _counted(old, columns, F.lit(1)).unionByName(come).unionByName(gone).groupBy("row").agg(F.sum("n").alias("n"))
    checked = F.when(F.col("n") >= 0, F.col("n")).otherwise(F.raise_error(F.lit("a change takes away a row that is not there")))
    return left.select("row", checked.alias("n")).filter("n > 0").select("row.*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("_n")).drop("_n")


def backwards(changes: DataFrame) -> DataFrame:
    """The same changes from the new snapshot to the old one."""
    action = F.when(F.col("action") == "insert", "delete").when(F.col("action") == "delete", "insert").otherwise(F.col("action"))
    swapped = {"before": F.col("after"), "after": F.col("before"), "action": action}
    return changes.select(*[swapped.get(c, F.col(c)).alias(c) for c in changes.columns])


def logged(changes: DataFrame, entity: str, keys: list[str], at: Column, actor: str = "system") -> DataFrame:
    """id, entity_type, entity_id, action, description, actor, created_at: activity log rows of changes at the given time; the description names the columns that an update changed."""
    from quillspark.functions.scalars import stable_id

    columns = [f.name for f in changes.schema["before"].dataType.fields]
    differ = F.array_compact(F.array(*[F.when(~F.col("before")[c].eqNullSafe(F.col("after")[c]), F.lit(c)) for c in columns]))
    entity_id = F.concat_ws("-", *[F.col(k).cast("string") for k in keys])
    description = F.when(F.col("action") == "update", F.concat_ws(",", differ)).otherwise(F.concat(F.col("times").cast("string"), F.lit(" rows")))
    images = F.to_json(F.struct("before", "after"))
    log_id = stable_id("log", F.lit(entity), entity_id, F.col("action"), images)
    return changes.select(log_id.alias("id"), F.lit(entity).alias("entity_type"), entity_id.alias("entity_id"), "action", description.alias("description"), F.lit(actor).alias("actor"), at.cast("string").alias("created_at"))
