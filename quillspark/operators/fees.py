"""Fees of several extracts: appending with isolated errors, histograms and totals."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillspark.sources.shared import written


def appended(spark: SparkSession, extracts: dict[str, Callable[[], DataFrame]], schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows of all extracts with their source in `src`, src and ok of every extract).

    An extract whose plan cannot be built, for a column or table that is not there, is left
    out and reported; the others go on. Rows are checked against the columns of `schema`.
    """
    every, report = spark.createDataFrame([], f"src string, {schema}"), []
    for src, build in extracts.items():
        try:
            rows = build().select(F.lit(src).alias("src"), *every.columns[1:])
        except AnalysisException:
            report.append((src, False))
            continue
        every = every.unionByName(rows)
        report.append((src, True))
    return every, spark.createDataFrame(report, "src string, ok boolean")


def quarantined(sources: dict[str, DataFrame], schema: StructType, required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(good rows of all sources with their source in `src`; src, place, column, value, reason of everything that is wrong).

    Sources give the columns of `schema` as raw cells of any type; each becomes a try_cast to its type. A cell that has a value but does
    not convert is a reject with the reason 'not a <type>', a missing or blank cell of a required column one with 'missing', and
    a column that the source lacks one without a place for the source as a whole, whose rows then count as wrong.
    A row with several wrong cells is as many rejects and no good row; the other rows of its source go on. `place` is a stable hash of the row, the same for
    repeated rows. Both come from one pass, which is written once.
    """
    parts, lacking = [], []
    for src, rows in sources.items():
        lacking += [(src, f.name) for f in schema if f.name not in rows.columns]
        if any(name == src for name, _ in lacking):
            continue
        raw = {f.name: F.col(f.name).cast("string") for f in schema}
        value = {f.name: F.col(f.name) if rows.schema[f.name].dataType == f.dataType else F.trim(raw[f.name]).try_cast(f.dataType) for f in schema}
        filled = {c: F.coalesce(F.trim(r) != "", F.lit(False)) for c, r in raw.items()}
        wrong = lambda c, reason, r: F.struct(F.lit(c).alias("column"), r.alias("value"), F.lit(reason).alias("reason"))
        checks = [F.when(filled[f.name] & value[f.name].isNull(), wrong(f.name, f"not a {f.dataType.simpleString()}", raw[f.name])) for f in schema]
        checks += [F.when(~filled[c], wrong(c, "missing", raw[c])) for c in required]
        parts.append(rows.select(F.lit(src).alias("src"), F.xxhash64(*raw.values()).alias("place"), *[v.alias(c) for c, v in value.items()], F.array_compact(F.array(*checks)).alias("_wrong")))
    lost = "src string, place long, column string, value string, reason string"
    spark = next(iter(sources.values())).sparkSession
    none = spark.createDataFrame([(src, None, column, None, "no such column") for src, column in lacking], lost)
    if not parts:
        return spark.createDataFrame([], StructType([StructField("src", StringType()), *schema.fields])), none
    checked = written(reduce(DataFrame.unionByName, parts), "quarantine")
    rejects = checked.select("src", "place", F.inline("_wrong")).unionByName(none)
    return checked.filter(F.size("_wrong") == 0).drop("_wrong", "place"), rejects


def histogram(rows: DataFrame) -> DataFrame:
    """cohort, student_type, amount, n of rows with an amount."""
    return rows.filter("amount IS NOT NULL").groupBy("cohort", "student_type", "amount").agg(F.count("*").alias("n"))


def totals(counted: DataFrame) -> DataFrame:
    """cohort, student_type, n, total and `amount:n` of every amount in order: the second level over the histogram."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("amount", "n"))), lambda x: F.concat_ws(":", x.amount.cast("string"), x.n.cast("string"))), ",")
    return counted.groupBy("cohort", "student_type").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("amount")).alias("total"), listed.alias("amounts"))
