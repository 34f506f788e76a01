"""Readers of tables, form sheets and JSON payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the folder; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(spark: SparkSession, sql: str, *params, **named) -> DataFrame:
    """Rows of parametrised SQL over registered tables; values are bound, never pasted."""
    return spark.sql(sql, args=named or list(params))


def query_one(spark: SparkSession, sql: str, *params, **named) -> DataFrame:
    """The first row, or none."""
    return query(spark, sql, *params, **named).limit(1)


def grid(spark: SparkSession, path: str) -> DataFrame:
    """A CSV sheet as strings `_c0`, `_c1`, …; line feeds inside quoted cells stay."""
    return spark.read.option("header", False).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def payload_rows(df: DataFrame, column: str, row: str) -> DataFrame:
    """Rows of JSON batches `[{"results": [row, …]}, …]` after any text before the first bracket.

    Adds batch, pos and the fields of `row` (a DDL list); a payload without a bracket
    or with malformed JSON gives no rows.
    """
    json = F.substring(F.col(column), F.locate("[", F.col(column)), F.length(column))
    batches = F.from_json(F.when(F.contains(F.col(column), F.lit("[")), json), f"array<struct<results: array<struct<{row}>>>>")
    out = df.select("*", F.posexplode(batches).alias("batch", "_b")).select("*", F.posexplode("_b.results").alias("pos", "_r"))
    return out.select(*df.columns, "batch", "pos", "_r.*")


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON files that hold one list each."""
    return spark.read.schema(schema).json(path, multiLine=True)
