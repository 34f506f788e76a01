"""Where results go: snapshots, resumable result folders, JSON and write-back columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.scoring import remaining


def write_snapshot(df: DataFrame, path: str, version: str) -> str:
    """Write one version of a table beside the earlier ones and return its folder; a reader never sees half of it.

    Snapshots are immutable: writing a version that is there is an error. So a transformation may read the version before while the next is written.
    """
    target = f"{path.rstrip('/')}/version={version}"
    df.write.parquet(target)
    return target


def read_snapshot(spark: SparkSession, path: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/version={version}")


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line; text beyond ASCII stays readable."""
    df.write.mode("overwrite").json(path)


def append_results(results: DataFrame, path: str) -> None:
    """Add finished rows to a result folder; every file that is there survives a stop."""
    results.write.mode("append").parquet(path)


def resume(rows: DataFrame, path: str, schema: str = "row long, reply string, error string") -> DataFrame:
    """Rows that the result folder does not hold yet; all of them where there is none."""
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return rows
    return remaining(rows, spark.read.schema(schema).parquet(path))


def write_back(grid: DataFrame, results: DataFrame, columns: list[str], key: str = "row") -> DataFrame:
    """A grid with result columns set where a row has a result, and its own values elsewhere."""
    new = results.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_n_{c}") for c in columns])
    both = grid.join(new, F.col(key) == F.col("_k"), "left")
    mine = [F.when(F.col("_k").isNotNull(), F.col(f"_n_{c}")).otherwise(F.col(c) if c in grid.columns else F.lit(None)).alias(c) for c in columns]
    return both.select(*[F.col(c) for c in grid.columns if c not in columns], *mine)


def match_report(matched: DataFrame, how: str = "how") -> DataFrame:
    """Rows per outcome of a match, with the least row of each as an example; partial sums keep a hot outcome cheap."""
    row = F.to_json(F.struct(*[F.col(c) for c in matched.columns if c != how]))
    return matched.groupBy(how).agg(F.count("*").alias("n"), F.min(row).alias("example"))
