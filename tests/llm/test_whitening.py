import math
import random

import numpy as np
import pytest

from tabulens.llm import whitening

SHAPE = "vec_id long, embedding array<float>, key string, x int"


@pytest.fixture(scope="module")
def embeddings(spark):
    floats = lambda v: v and [c if c is None else float(c) for c in v]
    return lambda vectors: spark.createDataFrame([(i, floats(v), "k", 5) for i, v in vectors], SHAPE)


def brute(vectors):
    """Of (key, x) with integers: n, sums, covariance, all with Python's integers and numpy."""
    distinct = sorted({tuple(x) for _, x in vectors})
    n, d = len(distinct), len(distinct[0])
    sums = [sum(x[i] for x in distinct) for i in range(d)]
    away = [[n * x[i] - sums[i] for i in range(d)] for x in distinct]
    covariance = np.array([[sum(y[i] * y[j] for y in away) / n**3 for j in range(d)] for i in range(d)])
    return n, sums, covariance


def check(rows, vectors, components=4):
    vectors = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in vectors]
    n, sums, covariance = brute(vectors)
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(rows) == len(vectors) * min(components, len(sums))
    got = {}
    for r in rows:
        got.setdefault((r.vec_id, r.component), []).append(r)
    signs = {}
    for i, x in vectors:
        y = [n * c - s for c, s in zip(x, sums)]
        for c in range(min(components, len(sums))):
            r = got[i, c + 1].pop()
            assert r.n == n and int(r.deviation) == sum(v * v for v in y)
            assert r.explained == pytest.approx(values[c] / np.trace(covariance), rel=1e-9)
            want = np.dot(np.array(y, float) / n, axes[:, c]) / np.sqrt(values[c])
            if abs(want) > 1e-6:
                signs.setdefault(c, np.sign(want) * np.sign(r.whitened))
                assert r.whitened == pytest.approx(want * signs[c], rel=1e-6, abs=1e-6)
            assert r.identity_error < 1e-9


def test_against_brute_force(embeddings):
    rng = random.Random(1)
    spread = [3, 2, 1.5, 1, 0.5, 0.2]
    vectors = [(i, [rng.gauss(0.3, s) for s in spread]) for i in range(300)]
    vectors += [(1000 + i, vectors[7][1]) for i in range(100)] + [(7, vectors[7][1])]
    bad = [(1, None), (2, [1.0, None, 2, 3, 4, 5]), (3, [math.nan] * 6), (4, [math.inf, 1, 2, 3, 4, 5]), (5, []), (6, [1.0, 2.0])]
    check(whitening.whiten(embeddings(vectors + bad)).collect(), vectors)


def test_null_keys_other_columns_and_empty_tables(embeddings):
    rows = whitening.whiten(embeddings([(None, [0.0, 1.0]), (None, [1.0, 0.0]), (2, [2.0, 5.0])])).collect()
    assert sorted((r.vec_id is None, r.component) for r in rows) == [(False, 1), (False, 2), (True, 1), (True, 1), (True, 2), (True, 2)]
    done = whitening.whiten(embeddings([]))
    assert done.collect() == [] and done.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(embeddings([(1, None), (2, [])])).collect() == []


def test_no_variance(embeddings):
    rows = whitening.whiten(embeddings([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(rows) == 4 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None for r in rows)
    rows = whitening.whiten(embeddings([(1, [1.0, 2.0]), (2, [3.0, 2.0])])).collect()
    assert {(r.vec_id, r.component): r.whitened for r in rows if r.component == 2} == {(1, 2): None, (2, 2): None}
    assert sorted(abs(r.whitened) for r in rows if r.component == 1) == pytest.approx([1, 1])


def test_large_values_and_bounds(embeddings):
    rng = random.Random(2)
    vectors = [(i, [rng.gauss(0, 8e5), rng.gauss(0, 10), rng.gauss(0, 3e4)]) for i in range(50)]
    check(whitening.whiten(embeddings(vectors)).collect(), vectors, 3)
    rows = whitening.whiten(embeddings([*vectors, (99, [3e38, 0.0, -3e38])])).collect()
    assert all(r.whitened is not None and math.isfinite(r.whitened) for r in rows)


def test_square_sums_are_exact_at_every_size():
    rng = random.Random(3)
    for bits in (3, 23, 24, 25, 31, 47, 49, 60):
        z = np.array([[rng.randrange(-(2**bits), 2**bits) for _ in range(3)] for _ in range(200)])
        for kind in (np.int64, object):
            assert whitening.square_sums(z.astype(kind), 0).tolist() == [sum(int(v) ** 2 for v in column) for column in z.T]
            assert whitening.square_sums(z.astype(kind), 1).tolist() == [sum(int(v) ** 2 for v in row) for row in z]


def test_query_against_numpy(spark, sf_dir):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    fine = [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    check(whitening.op13_whitened_vectors(spark, sf_dir).collect(), fine)
