import math

import numpy as np
import pytest

from conftest import DATA
from quillspark.llm import whitening
from quillspark.llm.queries import op12_embedding_whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def integers(vector):
    return [math.floor(64 * float(c)) + 1_000_000 for c in vector]


def brute(rows):
    """n, deviations, covariance and centred rows with plain integers."""
    kept = [(i, integers(v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n = len(kept)
    sums = [sum(x[k] for _, x in kept) for k in range(len(kept[0][1]))]
    apart = np.array([[n * x[k] - sums[k] for k in range(len(sums))] for _, x in kept], object)
    centred = apart.astype(float) / n
    return n, [(i, int(sum(c * c for c in a))) for (i, _), a in zip(kept, apart)], centred.T @ centred / n, centred


def test_query_against_plain_sums(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    n, deviations, v, centred = brute(rows)
    got = op12_embedding_whitening(spark, DATA).collect()
    assert len(got) == 32 * n and {r.n for r in got} == {n}
    assert sorted({(r.vec_id, r.deviation) for r in got}) == sorted(deviations)
    values = np.linalg.eigvalsh(v)[::-1]
    share = {r.component: r.explained for r in got}
    assert sorted(share) == list(range(1, 33))
    for k in range(32):
        assert share[k + 1] == pytest.approx(values[k] / np.trace(v), rel=1e-9)
    table = np.zeros((n, 32))
    place = {i: k for k, (i, _) in enumerate(deviations)}
    for r in got:
        table[place[r.vec_id], r.component - 1] = r.whitened
    error = np.abs(np.cov(table.T, bias=True) - np.eye(32)).max()
    assert error < 1e-9 and {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9
    # Projections on unit eigenvectors, over the root of the eigenvalue.
    directions = np.linalg.pinv(centred) @ table * np.sqrt(values[:32])
    assert np.allclose(np.linalg.norm(directions, axis=0), 1, atol=1e-9)
    assert np.allclose(v @ directions, directions * values[:32], atol=1e-9)


def test_nulls_repeats_and_lengths(spark):
    rows = [
        (1, [1.0, 2.0, 0.5], 0), (1, [1.0, 2.0, 0.5], 0), (None, [0.0, -1.0, 3.0], None), (3, None, 1), (4, [1.0, None, 2.0], 1), (5, [float("nan"), 1.0, 1.0], 1),
        (6, [float("inf"), 1.0, 1.0], 1), (7, [2.5, 1.0], 1), (2**60 + 1, [], 1), (9, [-0.01, 0.7, 9.0], None),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS id", "'x' AS _x", "'x' AS row")
    out, model, error = whitening.whiten(df)
    got = sorted(((r.id, r.deviation) for r in out.collect()), key=str)
    padded = [(i, (v + [0.0] * 3)[:3] if v is not None else None) for i, v, _ in rows]
    n, deviations, v, _ = brute(padded)
    assert model.n == n == 6 and got == sorted(deviations, key=str) and error < 1e-9
    assert np.allclose(model.explained, np.linalg.eigvalsh(v)[::-1] / np.trace(v))
    assert whitening.whiten(df.limit(0))[0].count() == 0


def test_no_variance_and_few_dimensions(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(5)], SCHEMA)
    out, model, error = whitening.whiten(same)
    assert (len(model.values), error) == (0, 0.0) and [r.deviation for r in out.collect()] == [0] * 5
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0], 0) for i in range(5)], SCHEMA)
    out, model, error = whitening.whiten(flat)
    assert len(model.values) == 1 and error < 1e-9 and {len(r.whitened) for r in out.collect()} == {1}


def test_entries_beyond_64_bits(spark):
    rows = [(1, [1e17, 1.0]), (2, [-1e17, 2.0]), (3, [3e38, 0.0]), (4, [0.5, 0.5])]
    out, model, error = whitening.whiten(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA))
    assert model.n == 4 and error < 1e-6 and out.count() == 4
    rows = [(1, [1e8, 1.0]), (2, [-1e8, 2.0]), (3, [0.5, 0.5])]
    out, model, error = whitening.whiten(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA))
    exact = {i: d if d < 1 << 63 else None for i, d in brute(rows)[1]}
    assert {r.id: r.deviation for r in out.collect()} == exact
