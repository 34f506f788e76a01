import math
import re

import numpy as np

from edge import ROWS, edge, empty
from quillspark.llm import quality
from quillspark.llm.common import text_slices
from quillspark.llm.queries import op2_quality_classifier


def test_held_out_ranking(spark):
    path = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{path}/labels.parquet")
    rows = op2_quality_classifier(spark, path).join(labels, "doc_id").filter("held_out").collect()
    good, bad = (np.array([r.score for r in rows if r.quality == q]) for q in (1, 0))
    assert (good[:, None] > bad[None]).mean() > 0.95
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)


def test_labels_of_held_out_rows_do_not_matter(spark):
    from pyspark.sql import functions as F

    from quillspark.llm.common import held_out

    path = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r.doc_id, r.score) for r in quality.classify(docs, x).collect()) for x in (labels, flipped))
    assert a == b


def test_edge_rows_and_empty(spark):
    labels = spark.createDataFrame([(2, 0), (4, 1), (5, None), (None, 1)], "doc_id long, quality int")
    rows = quality.classify(edge(spark), labels).collect()
    assert len(rows) == len(ROWS)
    assert len({r.score for r in rows if r.doc_id == 5}) == 1
    assert quality.classify(empty(spark), labels).count() == 0
    untrained = quality.classify(edge(spark), labels.limit(0)).collect()
    assert {r.score for r in untrained} == {0.5}


def test_scores_are_sparse_dot_products(spark):
    rng = np.random.Generator(np.random.PCG64(1))
    weights = np.where(rng.random(quality.SLOTS) < 0.3, rng.standard_normal(quality.SLOTS), 0).astype(np.float32)
    texts = ["one two one THREE", "", "vier fünf 66!!", "one"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for r in quality.score(df, (weights, 0.25)).collect():
        import pyarrow as pa

        ((_, _, data, offsets),) = text_slices(pa.array([texts[r.doc_id]]))
        slots, _ = quality.features(data, offsets)
        dot = sum(float(weights[s]) for s in slots) * quality.SCALE / max(1, len(slots)) + 0.25
        assert abs(r.score - 1 / (1 + np.exp(-dot))) < 2e-6


def plain_ftrl(samples, epochs=3, alpha=0.5, beta=1.0, l1=0.01, l2=0.1):
    """The published per-coordinate update, one coordinate after the other."""
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    for _ in range(epochs):
        for label, slots, values in samples:
            x = [*zip(map(int, slots), map(float, values)), (quality.SLOTS, 1.0)]
            w = {i: weight(i) for i, _ in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x)))
            for i, v in x:
                g = (p - label) * v
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_training_follows_the_regularised_leader():
    rng = np.random.Generator(np.random.PCG64(6))
    samples = [(int(rng.integers(2)), np.sort(rng.choice(50, 8, replace=False)), rng.random(8)) for _ in range(120)]
    want = plain_ftrl(samples)
    weights, bias = quality.train(samples)
    assert abs(bias - want[quality.SLOTS]) < 1e-9
    assert all(abs(weights[i] - want.get(i, 0.0)) < 1e-6 for i in range(quality.SLOTS) if i in want or weights[i])


def plain_features(text):
    """Words, pairs and shapes as texts; the slots follow from them one to one."""
    words = re.findall(r"[A-Za-z\u0080-\U0010ffff]+|[0-9]+|[^A-Za-z0-9\u0080-\U0010ffff\x20\x09-\x0d]+", text)
    out = []
    for i, w in enumerate(words):
        before = words[i - 1] if i else None
        caps = sum("A" <= c <= "Z" for c in w) > 1 and not any("a" <= c <= "z" for c in w)
        out += [("word", w), ("pair", before, w), ("shape", "again" if before == w else "caps" if caps else "other")]
    return out


def test_features_against_plain_words():
    import pyarrow as pa

    texts = ["One two two TWO 12ab !!x", "", " \n", "é1 ÉÉ AB ABc", "a a a", "One two"]
    ((_, _, data, offsets),) = text_slices(pa.array(texts))
    slots, bounds = quality.features(data, offsets)
    named = {}
    for i, text in enumerate(texts):
        own, want = slots[bounds[i] : bounds[i + 1]], plain_features(text)
        assert len(own) == len(want)
        for slot, feature in zip(own, want):
            assert named.setdefault(feature, slot) == slot
    assert len(set(named.values())) == len(named)  # different features have different slots here


def test_bounded_sample_keeps_every_label(spark):
    rows = [(i, f"text number {i} is plain " * 9, 0) for i in range(3000)] + [(5000, "the only good one", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    weights, bias = quality.fit(df, most_rows=50)
    assert np.count_nonzero(weights)
    small, _ = quality.fit(df, most_rows=50, most_bytes=400)
    assert 0 < np.count_nonzero(small) < np.count_nonzero(weights)


def test_bounded_bytes_of_large_texts():
    assert quality._ranges_within({0: 5, 1: 5, 9: 5}, 12) == 9
    assert quality._ranges_within({3: 5, 1: 5}, 10) == quality.RANGES + 1
    assert quality._ranges_within({7: 50, 8: 1}, 10) == 7 and quality._ranges_within({}, 1) == quality.RANGES + 1


def test_two_labels_of_one_document(spark):
    docs = spark.createDataFrame([(1, "good words", "x"), (3, "bad words", "x"), (4, "both", "x")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 1), (4, 0)], "doc_id long, quality int")
    assert quality.classify(docs, labels).count() == 3
    assert {r.held_out for r in quality.classify(docs.selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text"), labels).collect()} == {False}
