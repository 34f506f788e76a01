"""One local session for all tests, and the comparison of queries with their SQL."""

from __future__ import annotations

import os
import tempfile

import duckdb
import pytest
from pyspark.sql import SparkSession

DATA = os.environ.get("QUILLSPARK_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-quillspark-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return connection


def rows_of(columns: list[str], rows: list) -> list[str]:
    """Rows as texts with columns in order of name, sorted."""
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([r[i] for i in order]) for r in rows)


def assert_same(df, duck, sql: str) -> None:
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    theirs = result.fetchall()
    assert sorted(df.columns) == sorted(names)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert len(ours) == len(theirs)
    theirs = rows_of(names, theirs)
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    assert not wrong, f"{len(wrong)} rows differ, first:\n{wrong[0][0][:600]}\n{wrong[0][1][:600]}"
