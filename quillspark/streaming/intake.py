"""Form rows and scorer replies as they arrive.

The batch side resumes by anti-joining finished keys; a file stream with a
checkpoint gives the same without rereading: each file is taken once, and state
lies in the shared checkpoint folder, so a lost executor or a restarted driver
goes on where the last micro-batch ended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators import scoring


def arriving(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of Parquet files that are put into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def first_seen(rows: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """Rows whose key has not arrived before within the watermark; state older than that is dropped."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def counts_per_window(rows: DataFrame, at: str, width: str, late: str, *keys: str) -> DataFrame:
    """Rows per time window and keys; a window closes once the watermark has passed it."""
    return rows.withWatermark(at, late).groupBy(F.window(at, width).alias("window"), *keys).agg(F.count("*").alias("n"))


def score_replies(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Parse and weigh replies of what has arrived so far, append them to a folder and stop."""
    parsed = scoring.parsed(rows)
    return parsed.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
