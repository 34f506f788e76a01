"""Language identification by nearest centroids.

A text is the TF-IDF vector of its hashed letter trigrams, of length 1. Each
language has several centroids from spherical k-means over its vectors; the
language of the nearest centroid by cosine is the answer, and an answer is marked
rejected where its cosine lies below what nearly all training texts of that
centroid reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import held_out, key_bound, sample_key, text_slices

SLOTS = 1 << 13


class Centroids(NamedTuple):
    idf: np.ndarray  # slots
    vectors: np.ndarray  # centroids x slots
    langs: list[str]  # of each centroid
    reject: np.ndarray  # least cosine of each centroid


_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all byte trigrams of lower-case letters, with a blank at word ends, and n + 1 bounds by text."""
    if len(data) < 1:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    letter = _LETTER[data]
    # A blank before each text keeps trigrams inside it.
    n = len(offsets) - 1
    code = np.zeros(len(data) + n + 2, np.uint32)
    place = np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))
    code[place] = np.where(letter, data, 0)
    a, b, c = code[:-2], code[1:-1], code[2:]
    keep = (b > 0) & ((a > 0) | (c > 0))
    h = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    at = np.flatnonzero(keep)
    return (h[at] & np.uint32(SLOTS - 1)).astype(np.int64), np.searchsorted(at, offsets + np.arange(n + 1) - 1)


def _vectors(slots: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Texts x slots: 1 + log of the counts."""
    n = len(bounds) - 1
    text = np.repeat(np.arange(n), np.diff(bounds))
    counts = np.bincount(text * SLOTS + slots, minlength=n * SLOTS).reshape(n, SLOTS).astype(np.float32)
    return np.log1p(counts, out=counts)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def train(samples: list[tuple[str, np.ndarray, np.ndarray]], clusters: int = 4, rounds: int = 8, seed: int = 13) -> Centroids:
    """Centroids from (language, distinct slots, their counts); one language after the other, so memory holds one at a time."""
    texts = [s for s in samples if len(s[1])]
    seen = np.zeros(SLOTS)
    for _, at, _ in texts:
        seen[at] += 1
    idf = (np.log((1 + len(texts)) / (1 + seen)) + 1).astype(np.float32)
    rng = np.random.Generator(np.random.PCG64(seed))
    vectors, langs, reject = [], [], []
    for lang in sorted({t[0] for t in texts}):
        own = [t for t in texts if t[0] == lang]
        x = np.zeros((len(own), SLOTS), np.float32)
        for i, (_, at, count) in enumerate(own):
            x[i, at] = np.log1p(count) * idf[at]
        x = _unit(x)
        centre = x[rng.permutation(len(x))[:clusters]].copy()
        for _ in range(rounds):
            near = (x @ centre.T).argmax(1)
            centre = _unit(np.stack([x[near == k].mean(0) if (near == k).any() else centre[k] for k in range(len(centre))]))
        cosine = x @ centre.T
        near = cosine.argmax(1)
        for k in range(len(centre)):
            if (near == k).any():
                vectors.append(centre[k])
                langs.append(lang)
                reject.append(np.quantile(cosine[near == k, k], 0.01) * 0.8)
    return Centroids(idf, np.array(vectors, np.float32).reshape(-1, SLOTS), langs, np.array(reject))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """order_key, lang, text -> order_key, lang, slots (uint16 bytes, distinct), counts (uint32 bytes): 6 * SLOTS bytes a text at most."""
    for batch in batches:
        for first, last, data, offsets in text_slices(batch.column(2)):
            slots, bounds = trigrams(data, offsets)
            made: tuple[list, list] = ([], [])
            for a, b in zip(bounds[:-1], bounds[1:]):
                at, count = np.unique(slots[a:b], return_counts=True)
                made[0].append(at.astype(np.uint16).tobytes())
                made[1].append(count.astype(np.uint32).tobytes())
            head = [batch.column(i).slice(first, last - first) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*head, *[pa.array(x, pa.binary()) for x in made]], ["order_key", "lang", "slots", "counts"])


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_lang: int = 400, most_rows: int = 8000) -> Centroids:
    """Centroids from a bounded sample of rows with a language: those with the lowest hashed ids, whole texts.

    About `rows_per_lang` rows of each language, fewer where there are so many
    languages that this would exceed `most_rows` in all. Of more than `most_rows` languages
    the most frequent are learned, equal counts by name: the sample has one row of each, and rarer values belong to no
    centroid. A row is 6 * SLOTS bytes (48 KB) at most, so the driver holds 400 MB at most
    and usually a fifth of it, with `most_rows` counts at most.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull()).select(
        sample_key("lang", id_col).alias("order_key"), F.col(lang_col).cast("string").alias("lang"), F.lower(F.col(text_col).cast("string")).alias("text")
    )
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("order_key").alias("first")).orderBy(F.desc("n"), "lang").limit(most_rows).collect()
    if not counts:
        return train([])
    each = max(1, min(rows_per_lang, most_rows // len(counts)))
    bounds = labelled.sparkSession.createDataFrame([(r["lang"], key_bound(each, r["n"], r["first"])) for r in counts], "lang string, bound long")
    # One row per language, all of which the driver has just seen.
    taken = rows.join(F.broadcast(bounds), "lang").filter("order_key <= bound").select("order_key", "lang", "text")
    made = taken.mapInArrow(_sampled, "order_key long, lang string, slots binary, counts binary").collect()
    made.sort(key=lambda r: (r["order_key"], bytes(r["slots"]), bytes(r["counts"]), r["lang"]))
    return train([(r["lang"], np.frombuffer(r["slots"], np.uint16).astype(np.int64), np.frombuffer(r["counts"], np.uint32)) for r in made])


def _identified(model: Centroids, most: int = 64):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighted = (model.vectors * model.idf).T.copy()
        square = (model.idf * model.idf).astype(np.float32)
        for batch in batches:
            lettered = batch.column(2).to_numpy(zero_copy_only=False)
            for first, last, data, offsets in text_slices(batch.column(1)):
                slots, bounds = trigrams(data, offsets)
                langs, scores, rejected = [], [], []
                for at in range(0, last - first, most):
                    part = bounds[at : min(at + most, last - first) + 1]
                    x = _vectors(slots[part[0] : part[-1]], part - part[0])
                    norm = np.sqrt((x * x) @ square)
                    cosine = (x @ weighted) / np.maximum(norm, 1e-12)[:, None]
                    best = cosine.argmax(1) if len(model.langs) else np.zeros(len(x), int)
                    for i, k in enumerate(best):
                        known = bool(lettered[first + at + i]) and len(model.langs) > 0
                        value = min(1.0, max(0.0, float(cosine[i, k]))) if known else 0.0
                        langs.append(model.langs[k] if known else "und")
                        scores.append(round(value, 5))
                        rejected.append(not known or value < model.reject[k])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                    ["doc_id", "lang_pred", "score", "rejected"],
                )

    return run


def identify(docs: DataFrame, model: Centroids, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (cosine) and rejected of every row, whole texts, no shuffle.

    Null texts and texts without a letter are `und` with score 0. Only id and text
    are read; repeated rows give repeated results; ties go to the first language
    by name. Without training rows every text is `und`. Empty table: no rows.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.lower(text).alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_identified(model), f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def classify(docs: DataFrame, rows_per_lang: int = 400) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected, one row per row of `docs`; held-out rows and rows without an id are not learned from.

    Further columns are not read. Empty table: no rows.
    """
    model = fit(docs.select("doc_id", "text", "lang").filter(~held_out() & F.col("doc_id").isNotNull()), rows_per_lang=rows_per_lang)
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
