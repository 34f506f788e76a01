"""Whitening of embeddings: exact sums, MLlib's Gramian of centred rows, eigenvectors on the driver, projection in tasks.

Entries become integers, so that sums and deviations are exact. The covariance is
the Gramian of a RowMatrix of exactly centred rows, divided by their number; its
size follows the dimension of the vectors, never the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import staged

#: Fixed values of the integer form: entries times SCALE, rounded down, plus SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Variance below this share of the whole counts as none: such a component can't be whitened.
LEAST_SHARE = 1e-13
#: Integers below this stay inside 64 bits in one more addition.
LONG = 1 << 61


class Whitening(NamedTuple):
    """n rows with the exact sums of their integer entries; directions by falling eigenvalue and their share of the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray


def usable(vector: Column) -> Column:
    """Neither null nor with a null, NaN or infinite entry."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & ~bad


def integer_rows(df: DataFrame, vector_col: str) -> DataFrame:
    """The rows with a usable vector, with `_x`: its entries as integers without the shift."""
    whole = F.transform(F.col(vector_col).cast("array<double>"), lambda c: F.greatest(F.least(F.floor(c * SCALE), F.lit(1 << 62)), F.lit(-(1 << 62))))
    return df.filter(usable(F.col(vector_col).cast("array<double>"))).withColumn("_x", whole)


def _partial_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per task: how many vectors, and their sums by dimension."""
    n, sums = 0, np.zeros(0, object)
    for batch in batches:
        for width, rows in batch["_x"].groupby(batch["_x"].map(len)):
            n += len(rows)
            if width > len(sums):
                sums = np.append(sums, np.zeros(width - len(sums), object))
            if width:
                x = np.stack(rows.to_numpy())
                large = float(np.abs(x).max()) * len(x) >= LONG
                sums[:width] += x.astype(object if large else np.int64).sum(axis=0).astype(object)
    if n:
        yield pd.DataFrame({"n": [n], "sums": [[Decimal(int(s)) for s in sums]]})


def _padded(vectors: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows of one matrix; missing entries are zero."""
    out = np.zeros((len(vectors), width), np.int64)
    for size, rows in vectors.reset_index(drop=True).groupby(vectors.map(len).to_numpy()):
        if size:
            out[rows.index.to_numpy(), :size] = np.stack(rows.to_numpy())
    return out


def covariance(centred: DataFrame, column: str, n: int, width: int) -> np.ndarray:
    """Gramian of the rows of an array column, divided by n, by MLlib on the executors; partial sums of width squared go up a tree."""
    rows = MLUtils.convertVectorColumnsFromML(centred.select(array_to_vector(F.col(column)).alias("row")), "row")
    gram = RowMatrix(rows, n, width).computeGramianMatrix().toArray()
    return (gram + gram.T) / (2 * n)


def centred_rows(x: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """`row`: (n * x - S) / n of every vector, the difference in exact integers; the shift falls out of it."""
    at = lambda i: F.coalesce(F.get(F.col("_x"), i), F.lit(0).cast("long"))
    wide_sums = F.array(*[F.lit(Decimal(s)).cast("decimal(38,0)") for s in sums])
    row = F.transform(wide_sums, lambda s, i: (at(i).cast("decimal(20,0)") * F.lit(Decimal(n)) - s).cast("double") / n)
    if max(map(abs, sums)) < LONG:
        # 64 bits do wherever n times the entry stays inside them.
        small = F.forall("_x", lambda c: F.abs(c) < LONG // n)
        row = F.when(small, F.transform(F.array(*map(F.lit, sums)), lambda s, i: (at(i) * n - s).cast("double") / n)).otherwise(row)
    return x.select(row.alias("row"))


def fit(x: DataFrame, most: int = 32) -> Whitening:
    """Directions of the rows that integer_rows gives, `most` at most, without those of no variance.

    The driver holds one sum per dimension and one matrix of dimension squared.
    """
    parts = x.select("_x").mapInPandas(_partial_sums, "n long, sums array<decimal(38,0)>")
    totals = parts.select("n", F.posexplode_outer("sums")).groupBy("pos").agg(F.sum("col").alias("s"), F.sum("n").alias("n")).collect()
    # Every task has a row for the first dimension, or one without a dimension if it saw empty vectors only.
    n = sum(r["n"] for r in totals if not r["pos"])
    sums = [int(r["s"]) for r in sorted((r for r in totals if r["pos"] is not None), key=lambda r: r["pos"])]
    width = len(sums)
    nothing = Whitening(n, sums, np.zeros((width, 0)), np.zeros(0), np.zeros(0))
    if not n or not width:
        return nothing
    values, vectors = np.linalg.eigh(covariance(centred_rows(x, n, sums), "row", n, width))
    values, vectors, trace = values[::-1], vectors[:, ::-1], float(values.sum())
    kept = int(((values > LEAST_SHARE * trace) & (trace > 0))[:most].sum())
    return nothing._replace(vectors=vectors[:, :kept].copy(), values=values[:kept].copy(), explained=values[:kept] / trace if kept else np.zeros(0))


def _projected(model: Whitening):
    scaled = model.vectors / np.sqrt(model.values)
    sums = np.array(model.sums, np.float64)
    fits = max(map(abs, model.sums), default=0) < LONG
    short = np.array(model.sums if fits else np.zeros(len(sums)), np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _padded(batch["_x"], len(model.sums))
            # Floats tell which rows need longer integers than 64 bits.
            large = x.astype(np.float64) * model.n
            wide = (np.abs(large) >= LONG).any(axis=1) | (((large - sums) ** 2).sum(axis=1) >= LONG)
            with np.errstate(over="ignore"):
                apart = model.n * x - short
                deviation = (apart * apart).sum(axis=1).astype(object)
            centred = apart / model.n
            for i in np.flatnonzero(wide if fits else np.ones(len(x), bool)):
                own = [model.n * int(c) - int(s) for c, s in zip(x[i], model.sums)]
                total = sum(c * c for c in own)
                deviation[i], centred[i] = total if total < 1 << 63 else None, [c / model.n for c in own]
            out = batch.drop(columns="_x")
            out["deviation"] = pd.array(deviation, "Int64")
            out["whitened"] = list(centred @ scaled)
            yield out

    return run


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 32) -> tuple[DataFrame, Whitening, float]:
    """Rows (id, deviation, whitened) of all usable vectors, the model, and the largest error of the whitened rows' covariance.

    Rows whose vector is null or holds null or non-finite entries are left out; all
    others stay, repeated rows and null ids too. A shorter vector counts as padded with zeros to the longest.
    Entries beyond 2**62 / 64 count as that; a deviation beyond 64 bits is null. Components without variance
    (fewer rows or dimensions than `most`, equal rows) have no values, so whitened may be shorter than
    `most`, or empty. The rows are written once, in the shared folder, and the error is
    measured on what was written. Further columns are not read. Empty table: no rows, error 0.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    # Ids go as texts, since pandas would turn whole numbers beside a null into floats.
    x = integer_rows(rows, "vector").select(F.col("id").cast("string").alias("id"), "_x")
    model = fit(x, most)
    made = x.mapInPandas(_projected(model), "id string, deviation long, whitened array<double>")
    out = staged(made.withColumn("id", F.col("id").cast(rows.schema["id"].dataType)), "whitened")
    k = len(model.values)
    if not k:
        return out, model, 0.0
    means = [r["m"] for r in out.select(F.posexplode("whitened")).groupBy("pos").agg(F.avg("col").alias("m")).orderBy("pos").collect()]
    centre = F.array(*[F.lit(float(m)) for m in means])
    again = out.select(F.zip_with("whitened", centre, lambda w, m: w - m).alias("row"))
    return out, model, float(np.abs(covariance(again, "row", model.n, k) - np.eye(k)).max())
