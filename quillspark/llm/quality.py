"""Quality classifier: hashed word n-gram logistic regression, fitted by follow-the-regularised-leader.

A word is a run of letters, of digits or of other characters that are not white
space; the features of a text are its words and pairs of neighbouring words, and
whether a word repeats the one before or is all capitals, hashed to a fixed number
of slots with their relative frequencies as values. A score is the sparse dot
product of values and weights through the logistic function, so scoring is one pass
without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import held_out, key_bound, mix, run_hashes, sample_key, scratch, staged, text_slices

SLOTS = 1 << 20
#: Values are relative frequencies times this.
SCALE = 16.0
#: Ranges of the sample's keys whose sizes decide how much of it is taken.
RANGES = 1000

_CLASS = np.full(256, 3, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_CLASS[0x30:0x3A] = 2
_CAPITAL = np.zeros(256, bool)
_CAPITAL[0x41:0x5B] = True
_SMALL = np.zeros(256, bool)
_SMALL[0x61:0x7B] = True


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the first word of each text."""
    kind = _CLASS[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    keep = kind[starts] > 0 if len(data) else np.zeros(0, bool)
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(starts, offsets)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all feature occurrences, text by text, and n + 1 bounds."""
    starts, ends, first = _runs(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = run_hashes(data, starts, ends)
    before = np.concatenate((word[:1], word[:-1]))
    heads = first[:-1][np.diff(first) > 0]
    before[heads] = 0
    pair = mix(before * np.uint64(3) + word)
    caps, small = (np.concatenate(([0], np.cumsum(t[data], dtype=np.int64))) for t in (_CAPITAL, _SMALL))
    shout = (caps[ends] - caps[starts] > 1) & (small[ends] == small[starts])
    shape = np.where(word == before, np.uint64(1), np.where(shout, np.uint64(2), np.uint64(3)))
    every = np.stack((word, pair, mix(shape)), axis=1)
    return (every & np.uint64(SLOTS - 1)).astype(np.int64).ravel(), first * 3


def train(samples: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.01, l2: float = 0.1) -> tuple[np.ndarray, float]:
    """FTRL-proximal over (label, slots, values): per-coordinate rates, L1 and L2. Returns weights and bias."""
    z, n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)

    def weight(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    for _ in range(epochs):
        for label, slots, values in samples:
            at = np.append(slots, SLOTS)
            x = np.append(values, 1.0)
            w = weight(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    final = weight(np.arange(SLOTS + 1))
    return final[:-1].astype(np.float32), float(final[-1])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """order_key, label, text -> order_key, label, slots (uint32 bytes), values (float32 bytes)."""
    for batch in batches:
        for first, last, data, offsets in text_slices(batch.column(2)):
            slots, bounds = features(data, offsets)
            made: tuple[list, list] = ([], [])
            for a, b in zip(bounds[:-1], bounds[1:]):
                at, count = np.unique(slots[a:b], return_counts=True)
                made[0].append(at.astype(np.uint32).tobytes())
                made[1].append((count * (SCALE / max(1, b - a))).astype(np.float32).tobytes())
            head = [batch.column(i).slice(first, last - first) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*head, *[pa.array(x, pa.binary()) for x in made]], ["order_key", "label", "slots", "values"])


def _ranges_within(sizes: dict[int, int], most_bytes: int) -> int:
    """The first range of keys that, with all before it, exceeds most_bytes; RANGES + 1 if none does."""
    total = 0
    for at in sorted(sizes):
        total += sizes[at]
        if total > most_bytes:
            return at
    return RANGES + 1


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label", most_rows: int = 6000, most_bytes: int = 256 << 20) -> tuple[np.ndarray, float]:
    """Weights and bias from rows with a label of 0 or 1.

    The sample is bounded: about `most_rows` rows with the lowest hashed ids, whole
    texts, of each label one at least, and of these in hash order as many whole ranges of
    hashes (RANGES in all) as have `most_bytes` of sparse features. Those features come to the driver, where the
    sequential fit runs; no other task sees more of them than its own share of the sample. Null labels are left out; several labels of one document are
    as many rows. Without labels every weight is 0 and scores are 0.5.
    """
    rows = labelled.filter(F.col(label_col).isNotNull()).select(
        sample_key("quality", id_col).alias("order_key"), F.col(label_col).cast("int").alias("label"), F.col(text_col).cast("string").alias("text")
    )
    classes = rows.groupBy("label").agg(F.count("*").alias("n"), F.min("order_key").alias("first")).collect()
    count = sum(r["n"] for r in classes)
    wanted = first = F.lit(False)
    for r in classes:
        wanted = wanted | ((F.col("label") == r["label"]) & (F.col("order_key") <= key_bound(most_rows, count, r["first"])))
        first = first | ((F.col("label") == r["label"]) & (F.col("order_key") == r["first"]))
    if not classes:
        return train([])
    size = F.octet_length("slots") + F.octet_length("values")
    share = F.least(F.expr(f"order_key div {max(1, key_bound(most_rows, count) // RANGES)}"), F.lit(RANGES))
    with scratch(labelled.sparkSession):
        made = staged(rows.filter(wanted).mapInArrow(_featured, "order_key long, label int, slots binary, values binary"), "quality-sample")
        sizes = made.groupBy(share.alias("range")).agg(F.sum(size).alias("size")).collect()
        sample = made.filter((share < _ranges_within({r["range"]: r["size"] for r in sizes}, most_bytes)) | first).collect()
    sample.sort(key=lambda r: (r["order_key"], bytes(r["slots"]), r["label"]))
    return train([(r["label"], np.frombuffer(r["slots"], np.uint32).astype(np.int64), np.frombuffer(r["values"], np.float32).astype(float)) for r in sample])


def _scored(weights: np.ndarray, bias: float):
    kept = np.flatnonzero(weights)
    packed = (kept.astype(np.int32), weights[kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(SLOTS, np.float32)
        table[packed[0]] = packed[1]
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column(1)):
                slots, bounds = features(data, offsets)
                sums = np.concatenate(([0.0], np.cumsum(table[slots], dtype=np.float64)))[bounds]
                dot = np.diff(sums) * SCALE / np.maximum(1, np.diff(bounds)) + bias
                score = np.round(1 / (1 + np.exp(-np.clip(dot, -35, 35))), 6)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(score)], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) of every row, whole texts.

    Only id and text are read. Null and empty texts get the score of the bias;
    equal texts get equal scores up to rounding at 6 digits. Empty table: no rows.
    """
    pairs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return pairs.mapInArrow(_scored(*model), f"doc_id {pairs.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, most_rows: int = 6000) -> DataFrame:
    """doc_id, held_out, score and predicted, one row per row of `docs`; labels of held-out rows are not learned from.

    A null doc_id is not held out and has no labels. Several labels of one document
    are as many training rows. Further columns are not read. Empty table: no rows.
    """
    learn = docs.select("doc_id", "text").filter(~held_out()).join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id")
    scored = score(docs, fit(learn, most_rows=most_rows))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
