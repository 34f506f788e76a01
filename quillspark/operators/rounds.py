"""Calls to an outside scorer in rounds over a written state: no task sleeps, and what is finished is never asked again."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One row per call: its row, which attempt it was, and the reply or the error.
STATE = "row long, attempt int, reply string, error string"


def _called(scorer: Callable[[str], str], errors: tuple[type[Exception], ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, attempt, message in zip(batch["row"], batch["attempt"], batch["message"]):
                try:
                    out.append((row, attempt, scorer(message), None))
                except errors as e:
                    out.append((row, attempt, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["row", "attempt", "reply", "error"])

    return run


def state(rows: DataFrame, path: str) -> DataFrame:
    """The calls that are finished; the folder is made if it is not there."""
    spark = rows.sparkSession
    spark.createDataFrame([], STATE).write.mode("append").parquet(path)
    return spark.read.schema(STATE).parquet(path)


def open_rows(rows: DataFrame, done: DataFrame, attempts: int) -> DataFrame:
    """row, message, attempt of rows without a reply that have attempts left, with the number of the next attempt."""
    last = done.groupBy(F.col("row").alias("_row")).agg(F.max("attempt").alias("_last"), F.count("reply").alias("_replies"))
    left = rows.join(last, F.col("row") == F.col("_row"), "left").filter(F.coalesce("_replies", F.lit(0)) == 0).withColumn("attempt", F.coalesce("_last", F.lit(0)) + 1)
    return left.filter(F.col("attempt") <= attempts).select(F.col("row").cast("long").alias("row"), "message", F.col("attempt").cast("int").alias("attempt"))


def score_in_rounds(
    rows: DataFrame, scorer: Callable[[str], str], path: str, attempts: int = 4, pause: float = 1.0, batches: int = 1, errors: tuple[type[Exception], ...] = (Exception,), wait: Callable[[float], None] = time.sleep
) -> DataFrame:
    """row, attempts, reply, error of every row that was called: its reply, or the error of its last attempt.

    `rows` has row (once each, not null) and message. Every round calls each open row once, in `batches` jobs by hash of the
    row, and each job's calls are committed to `path` as a whole before the next begins. The driver waits
    pause * 2**k seconds between rounds, while no task holds a core. A run that was stopped goes on from what is
    committed, with the attempts that each row has left; a lost executor repeats the calls of its tasks of one job at most.
    Only `errors` count as answers of the scorer; any other exception stops the run.
    """
    for k in range(attempts):
        for part in range(batches):
            todo = open_rows(rows, state(rows, path), attempts).filter(F.col("attempt") <= k + 1).filter(F.pmod(F.xxhash64("row"), F.lit(batches)) == part)
            todo.mapInPandas(_called(scorer, errors), STATE).write.mode("append").parquet(path)
        if not open_rows(rows, state(rows, path), attempts).head(1):
            break
        wait(pause * 2**k)
    best = F.max_by(F.struct("reply", "error"), "attempt")
    return state(rows, path).groupBy("row").agg(F.max("attempt").alias("attempts"), best.alias("_b")).select("row", "attempts", "_b.reply", "_b.error")
