"""Ranked lexical search: a blocked product of item-term multiplicities and term-document impacts.

Documents become blocks of a sparse matrix, one row per block in a written table:
postings (term by term, Gustavson's row order) of the terms that the items hold.
Document frequencies, lengths and counts of all documents are sums over these
blocks. A second pass turns frequencies into 64-bit impacts, merges for each item the
impact rows of its terms, and keeps the best of the block, of the task and of all.

Items are taken in blocks of a bounded size; every block of items meets all documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import buckets, running, staged
from quillspark.llm.terms import numbers_in, term_slices

#: Text of the items that meet the documents at once; also the bound of what a closure carries and the driver holds.
ITEM_BYTES = 1 << 24
#: Text behind one block of the term-document matrix.
DOC_BYTES = 1 << 22


def weight(n_docs: int, holding: int) -> int:
    """A term's weight from the number of documents and of those that hold it."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding + 1)))


def length_factors(lengths: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """m of documents by their number of terms; exact also where the product exceeds 64 bits."""
    if not len(lengths):
        return lengths.astype(np.int64)
    if 75 * int(lengths.max()) * n_docs < 1 << 63:
        return 25 + (75 * lengths.astype(np.int64) * n_docs) // all_terms
    return np.array([25 + 75 * n * n_docs // all_terms for n in lengths.tolist()], np.int64)


class Items:
    """Sparse item-term matrix of one block of items, by rows: numbers and multiplicities of each item's terms."""

    def __init__(self, ids: list, texts: list[str | None], id_type: pa.DataType):
        self.ids, rows = pa.array(ids, id_type), []
        found = [(terms, bounds) for _, _, terms, bounds in term_slices(pa.array(texts, pa.large_string()))]
        every = pa.chunked_array([t for t, _ in found], pa.large_binary())
        self.vocabulary = pc.unique(every)
        for terms, bounds in found:
            numbers = numbers_in(terms, self.vocabulary)
            rows += [np.unique(numbers[a:b], return_counts=True) for a, b in zip(bounds[:-1], bounds[1:])]
        self.rows = rows


def _blocks(vocabulary: pa.Array, doc_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, terms, bounds in term_slices(batch.column(1), doc_bytes):
                lengths = np.diff(bounds)
                number = numbers_in(terms, vocabulary)
                document = np.repeat(np.arange(len(lengths)), lengths)
                known = number >= 0
                # Columns of the block stand in order of document id, so that the first of equal scores has the lowest.
                ids = batch.column(0).slice(first, last - first)
                order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                cell, times = np.unique(number[known].astype(np.int64) * len(lengths) + place[document[known]], return_counts=True)
                rows, held = np.unique(cell // max(1, len(lengths)), return_counts=True)
                column = {
                    "ids": ids.take(pa.array(order)),
                    "lengths": pa.array(lengths[order].astype(np.int64)),
                    "terms": pa.array(rows.astype(np.int32)),
                    "held": pa.array(held.astype(np.int64)),
                    "documents": pa.array((cell % max(1, len(lengths))).astype(np.int32)),
                    "times": pa.array(times.astype(np.int64)),
                }
                lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in column.values()]
                counts = [pa.array([int((lengths > 0).sum())], pa.int64()), pa.array([int(lengths.sum())], pa.int64())]
                yield pa.RecordBatch.from_arrays([*lists, *counts], [*column, "n_docs", "n_terms"])

    return run


def merged_scores(rows: list[tuple[np.ndarray, np.ndarray]], slot: np.ndarray, edges: np.ndarray, documents: np.ndarray, impacts: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of the product, (item, scores of the block's documents), of items that share a term with the block.

    Gustavson's order: the row of an item is the sum of the impact rows of its terms,
    each times its multiplicity, in one dense accumulator. Within an impact row documents differ, so plain indexed sums are exact.
    """
    for item, (terms, multiplicity) in enumerate(rows):
        at = slot[terms]
        here = at >= 0
        if not here.any():
            continue
        scores = np.zeros(width, np.int64)
        for s, times in zip(at[here], multiplicity[here]):
            a, b = edges[s], edges[s + 1]
            scores[documents[a:b]] += times * impacts[a:b]
        yield item, scores


def _best(table: pa.Table, most: int) -> pa.Table:
    """The `most` best rows of each item."""
    table = table.take(pc.sort_indices(table, sort_keys=[("item", "ascending"), ("score", "descending"), ("doc_id", "ascending")], null_placement="at_end"))
    item = table["item"].to_numpy()
    first = np.flatnonzero(np.append(True, item[1:] != item[:-1])) if len(item) else np.zeros(0, np.int64)
    nth = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item))))
    return table.filter(pa.array(nth < most))


def _ranked(items: Items, weights: np.ndarray, n_docs: int, all_terms: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: pa.Table | None = None
        slot = np.empty(len(weights), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column(0)[i].values
                lengths, terms, held, documents, times = (batch.column(k)[i].values.to_numpy() for k in range(1, 6))
                edges = np.append(0, np.cumsum(held))
                slot[:] = -1
                slot[terms] = np.arange(len(terms))
                m = length_factors(lengths, n_docs, all_terms)
                impacts = np.repeat(weights[terms], held) * ((1_000_000_000 * times) // (1000 * times + 8 * m[documents]))
                found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for item, scores in merged_scores(items.rows, slot, edges, documents, impacts, len(lengths)):
                    some = np.flatnonzero(scores > 0)
                    if len(some) > most:
                        some = some[scores[some] >= np.partition(scores[some], -most)[-most]]
                        some = some[np.argsort(-scores[some], kind="stable")[:most]]
                    found.append((np.full(len(some), item), some, scores[some]))
                if found:
                    item, at, score = (np.concatenate(x) for x in zip(*found))
                    block = pa.table({"item": pa.array(item, pa.int32()), "doc_id": ids.take(pa.array(at)), "score": pa.array(score, pa.int64())})
                    best = _best(block if best is None else pa.concat_tables([best, block]), most)
        if best is not None and best.num_rows:
            out = pa.table({"item": best["item"], "item_id": items.ids.take(best["item"].combine_chunks()), "doc_id": best["doc_id"], "score": best["score"]})
            yield from out.combine_chunks().to_batches()

    return run


def item_blocks(items: DataFrame, id_col: str, text_col: str, item_bytes: int) -> tuple[DataFrame, int]:
    """item_id, text, block: blocks of about item_bytes of text, each read by its number; and how many blocks there are."""
    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 64)
    order = [F.xxhash64("item_id", "text"), F.col("item_id"), F.col("text")]
    placed = running(rows, order, {"before": F.col("size")}, "search-items")
    blocks = staged(placed.select("item_id", "text", F.expr(f"before div {item_bytes}").cast("int").alias("block")), "search-item-blocks")
    last = blocks.agg(F.max("block")).first()[0]
    return blocks, 0 if last is None else last + 1


def search(docs: DataFrame, items: DataFrame, most: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", item_bytes: int = ITEM_BYTES, doc_bytes: int = DOC_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the `most` best documents of every row of `items`, with scores above 0.

    Equal scores go by ascending doc_id, null ids last. Null texts, texts without
    terms and items that share no term with any document give no rows; repeated
    documents are documents of their own and each row of `items` has its own ranks. Frequencies
    and lengths count all documents, also where there are several blocks of items. Further columns are not read. Texts of
    any length are read whole; a single text is never cut between blocks.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind, item_kind = texts.schema["doc_id"].dataType.simpleString(), items.schema[item_id_col].dataType
    found = f"item int, item_id {item_kind.simpleString()}, doc_id {kind}, score long"
    queue, n_blocks = item_blocks(items, item_id_col, item_text_col, item_bytes)
    parts = []
    for number in range(n_blocks):
        held = queue.filter(F.col("block") == number).toArrow()
        block = Items(held["item_id"].to_pylist(), held["text"].to_pylist(), held.schema.field("item_id").type)
        matrix = texts.mapInArrow(_blocks(block.vocabulary, doc_bytes), f"ids array<{kind}>, lengths array<long>, terms array<int>, held array<long>, documents array<int>, times array<long>, n_docs long, n_terms long")
        matrix = staged(matrix, "search-matrix")
        n_docs, all_terms = matrix.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        # One row per term of the block of items at most.
        holding = matrix.select(F.inline(F.arrays_zip("terms", "held"))).groupBy("terms").agg(F.sum("held").alias("held")).collect()
        weights = np.zeros(len(block.vocabulary), np.int64)
        for r in holding:
            weights[r["terms"]] = weight(n_docs, r["held"])
        parts.append(matrix.drop("n_docs", "n_terms").mapInArrow(_ranked(block, weights, n_docs, all_terms, most), found).withColumn("block", F.lit(number)))
    if not parts:
        return spark.createDataFrame([], T.StructType([T.StructField("item_id", item_kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", texts.schema["doc_id"].dataType), T.StructField("score", T.LongType())]))
    every = reduce(DataFrame.unionByName, parts).withColumn("salt", F.spark_partition_id() % buckets(spark))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # Tasks hold `most` rows of an item each; these meet in salted groups first.
    some = every.withColumn("nth", F.row_number().over(Window.partitionBy("block", "item", "salt").orderBy(*order))).filter(F.col("nth") <= most)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("block", "item").orderBy(*order))).filter(F.col("rank") <= most)
    return ranked.select("item_id", "rank", "doc_id", "score")
