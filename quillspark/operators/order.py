"""Places in a global order without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.sources.shared import fresh_path


def placed(df: DataFrame, order: list[Column], place: str = "place") -> DataFrame:
    """`df` with its row number in `order`, from 1.

    Rows are dealt by ranges of the order and written with the number of their range;
    the rows of the ranges before, one sum a range, and a row number inside the range
    add up to the place.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = fresh_path(spark, "placed")
    df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_in", inside).join(bases, "_range").select(*df.columns, (F.col("_base") + F.col("_in")).alias(place))
