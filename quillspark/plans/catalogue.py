"""Registry of queries and of the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.plans import changes, editing, editorial, forms, intake, reports, storage, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

for module in (reports, changes, forms, texts, editing, editorial, intake, storage):
    QUERIES.update(module.QUERIES)
    ORACLES.update(module.ORACLES)
