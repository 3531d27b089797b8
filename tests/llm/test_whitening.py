"""Whitening against numpy's eigenvectors of the covariance."""

import numpy as np

from lokalens.llm import whitening as W
from lokalens.llm.registry import QUERIES

SCHEMA = "vec_id long, embedding array<float>"


def compare(vectors, rows, components=W.COMPONENTS):
    x = np.floor(64 * np.array([v for _, v in vectors], np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, int((values > 1e-11 * values[0]).sum()))
    white = centred @ axes[:, :k] / np.sqrt(values[:k])
    deviation = [sum(int(d) ** 2 for d in row) for row in n * x - sums]
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(got) == len(rows) == n * k
    mine = np.array([[got[i, c + 1]["whitened"] for c in range(k)] for i, _ in vectors])
    assert np.abs(mine * np.sign((mine * white).sum(axis=0)) - white).max() < 1e-7
    for (i, _), d in zip(vectors, deviation, strict=True):
        assert got[i, 1]["deviation"] == d and got[i, 1]["n"] == n
    first = vectors[0][0]
    assert np.allclose([got[first, c + 1]["explained"] for c in range(k)], values[:k] / values.sum(), rtol=1e-6)
    assert max(r["identity_error"] for r in rows) < 1e-4


def test_random_vectors(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((500, 40)) * np.linspace(0.2, 3, 40))]
    compare(vectors, W.whiten(spark.createDataFrame(vectors, SCHEMA)).collect())


def test_low_rank_and_few_vectors(spark):
    rng = np.random.default_rng(2)
    steps = rng.integers(-40, 40, (300, 3)) @ rng.integers(-2, 3, (3, 50)) / 64.0
    vectors = [(i, v.tolist()) for i, v in enumerate(steps)]
    compare(vectors, W.whiten(spark.createDataFrame(vectors, SCHEMA)).collect())
    few = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((5, 50)))]
    compare(few, W.whiten(spark.createDataFrame(few, SCHEMA)).collect())


def test_rows_that_take_no_part(spark):
    rng = np.random.default_rng(3)
    good = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((60, 4)))]
    bad = [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0]), (103, [float("nan")] * 4), (104, [float("inf"), 0.0, 0.0, 0.0]), (105, [1.0, 2.0]), (106, [3e38, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, [1]) for r in good + bad], SCHEMA + ", component int, x array<int>")
    compare(good, W.whiten(df).collect())


def test_no_rows_and_no_variance(spark):
    assert W.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert W.whiten(spark.createDataFrame([(1, [0.5, 0.5]), (None, [0.5, 0.5])], SCHEMA)).count() == 0


def test_repeated_rows_and_null_ids_are_rows(spark):
    vectors = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (None, [2.0, -1.0])]
    rows = W.whiten(spark.createDataFrame(vectors, SCHEMA)).collect()
    assert sorted((r["vec_id"] is None, r["component"]) for r in rows) == [(False, 1), (False, 1), (True, 1)]


def test_lanczos_restarts_converges_and_stops_early():
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.standard_normal((300, 300)))
    values = np.concatenate([np.geomspace(1000, 50, 10), np.full(5, 20.0), np.zeros(285)])  # invariant spaces: blocks lose rank
    matrix, calls = (q * values) @ q.T, []

    def product(block):
        calls.append(block.shape[1])
        return matrix @ block

    found, axes = W.block_lanczos(product, 300, 12, block=6)
    assert np.allclose(found, values[:12], rtol=1e-10) and np.abs(axes.T @ axes - np.eye(12)).max() < 1e-12
    assert np.linalg.norm(matrix @ axes - axes * found, axis=0).max() < 1e-8 * 1000 and sum(calls) < 150


def test_exact_deviations_beyond_floats():
    assert list(W.deviations(np.array([[3_000_000_007, 1], [5, 4]]))) == [3_000_000_007**2 + 1, 41]
    assert list(W.deviations(np.array([[30_000_007, 1], [5, 4]]))) == [30_000_007**2 + 1, 41]


def test_query_over_its_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    compare(vectors, QUERIES["op13_whitening"](spark, sf).collect())
