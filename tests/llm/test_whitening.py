import math
import random

import numpy as np
import pytest

from loomdoc.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n int, component string, whitened string"


def table_of(spark, vectors, parts=5):
    return spark.createDataFrame([(k, v, 1, "c", "w") for k, v in enumerate(vectors)], SCHEMA).repartition(parts)


def check(spark, vectors, parts=5, components=32):
    clean = [(k, v) for k, v in enumerate(vectors) if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in clean]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    centred = np.array([[(n * r[j] - sums[j]) / n for j in range(d)] for r in x])
    cov = centred.T @ centred / n
    values = np.linalg.eigvalsh(cov)[::-1]
    got = whitening.whiten(table_of(spark, vectors, parts), components).collect()
    many = min(components, d)
    assert len(got) == n * many and {r["n"] for r in got} == {n}
    deviation = {k: sum((n * r[j] - sums[j]) ** 2 for j in range(d)) for (k, _), r in zip(clean, x)}
    assert all(r["deviation"] == deviation[r["vec_id"]] for r in got)
    by = {(r["vec_id"], r["component"]): r for r in got}
    white = np.array([[by[k, c]["whitened"] for c in range(1, many + 1)] for k, _ in clean], float)
    varied = values[:many] > 1e-9 * max(values[0], 0)
    for c in range(many):
        assert by[clean[0][0], c + 1]["explained"] == pytest.approx(values[c] / np.trace(cov) if np.trace(cov) else 0, abs=1e-9, rel=1e-6)
    assert np.isnan(white[:, ~varied]).all()
    w = white[:, varied]
    assert np.abs(w.T @ w / n - np.eye(w.shape[1])).max(initial=0) < 1e-6
    assert np.abs(w.mean(axis=0)).max(initial=0) < 1e-6 and {r["identity_error"] for r in got}.pop() < 1e-6
    # each whitened component is a unit eigenvector's projection over the root of its value
    for c in np.flatnonzero(varied):
        direction = np.linalg.lstsq(centred, white[:, c] * math.sqrt(values[c]), rcond=None)[0]
        assert np.abs(cov @ direction - values[c] * direction).max() < 1e-6 * values[0]
    return got


def test_whitening_equals_a_dense_solution(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(700, 40)) @ rng.normal(size=(40, 40))).tolist()
    vectors += [None, [], [float("nan")] * 40, [float("inf")] + [0.0] * 39, [None] + [0.0] * 39, [1.0, 2.0]] + [vectors[7]] * 300
    vectors = [v if v != [1.0, 2.0] else None for v in vectors]
    check(spark, vectors)
    check(spark, vectors, parts=40, components=5)


def test_small_and_flat_tables(spark):
    check(spark, [[1.0, 2.0, 3.0]])
    check(spark, [[0.5, -0.25]] * 9)
    rng = random.Random(2)
    check(spark, [[x := rng.uniform(-5, 5), 0.0, rng.uniform(-1, 1), 7.0] for _ in range(60)])
    check(spark, [[rng.uniform(-1, 1)] for _ in range(30)])


def test_no_vector_is_left(spark):
    assert whitening.whiten(table_of(spark, [None, []])).collect() == []
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []


def test_other_lengths_are_dropped_and_null_ids_stay(spark):
    rows = [(None, [1.0, 2.0]), (1, [2.0, 1.0]), (1, [0.0, 0.5]), (2, [1.0, 2.0, 3.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2)]


def test_out_of_range(spark):
    with pytest.raises(Exception, match="beyond 2"):
        whitening.whiten(table_of(spark, [[1e20], [0.0]])).collect()


def test_merged_summaries_equal_one_run():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(101, 6)) + 50
    parts = [whitening.Moments.none(6) for _ in range(4)]
    for k, v in enumerate(x):
        parts[k % 3].add(v)
    out = parts[3]
    for p in parts[:3]:
        out = out.merged(p)
    assert out.n == 101 and np.allclose(out.covariance(), np.cov(x.T, bias=True), rtol=1e-12, atol=1e-12) and np.allclose(out.mean, x.mean(axis=0))


@pytest.mark.parametrize("d", [1, 2, 3, 17, 64])
def test_eigen_of_random_and_degenerate_matrices(d):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(d, d))
    for m in (a + a.T, a @ a.T, np.eye(d), np.zeros((d, d)), np.ones((d, d)), np.diag(np.arange(d) % 3.0)):
        values, vectors = whitening.eigen(m)
        assert np.allclose(values, np.linalg.eigvalsh(m)[::-1], atol=1e-11 * max(1, abs(m).max() * d))
        assert np.abs(m @ vectors - vectors * values).max() < 1e-11 * max(1, d * abs(m).max()) and np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-12
