"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_paths: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in local mode without it."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="quillspark-"))
    return _own[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A folder below the shared one that nobody else writes to; it goes at the end of the process."""
    _delete_at_exit(spark)
    _paths.append(f"{shared_dir(spark)}/quillspark/{name}-{uuid.uuid4().hex}")
    return _paths[-1]


def delete_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders, if the session still runs."""
    if spark.sparkContext._jsc is None:
        return
    for item in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(item)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gone = set(paths)
    _paths[:] = [x for x in _paths if x not in gone]


@functools.cache
def _delete_at_exit(spark: SparkSession) -> None:
    atexit.register(lambda: delete_paths(spark, list(_paths)))


def written(df: DataFrame, name: str) -> DataFrame:
    """`df`, written to the shared folder and read back: what follows is recomputed from there when an executor is lost."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
