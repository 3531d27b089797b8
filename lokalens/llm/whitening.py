"""Whitening of embeddings by the leading eigenvectors of their covariance, which is never formed.

A block of vectors is multiplied by the covariance in one pass over the table: each task centres its rows
and sends the sum of x (x'v), a matrix of dimensions by block. The block Krylov space of such products is
orthogonalised in full; where a block loses rank, it goes on from fresh directions. The driver holds the
basis alone, at most dimensions squared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, materialize, table

#: Components returned, vectors multiplied in one pass, residual (as a share of the largest eigenvalue) at which they count as found, and the share of it under which an eigenvalue is none.
COMPONENTS, BLOCK, RESIDUAL, NO_VARIANCE = 32, 16, 1e-13, 1e-11
#: x = floor(SCALE * entry) + SHIFT; entries over LARGEST have no such long.
SCALE, SHIFT, LARGEST = 64.0, 1_000_000, 2.0**50
#: Rows of a batch that are multiplied at once.
ROWS = 4096


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): the vectors that take part, entries as longs.

    Null and empty vectors and those that hold a null, a non-finite or an entry over LARGEST do not; of several
    lengths only vectors of the most frequent one do, of equals the longest."""
    entry = F.col("embedding")
    fine = F.forall(entry, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) <= LARGEST))
    found = vectors.select("vec_id", "embedding").where((F.size(entry) > 0) & fine)
    lengths = found.groupBy(F.size(entry).alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = lengths["dim"] if lengths else 0
    x = F.transform(entry, lambda v: F.floor(v.cast("double") * SCALE).cast("long") + SHIFT)
    return found.where(F.size(entry) == dim).select("vec_id", x.alias("x"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The x-vectors of a batch as rows."""
    x = batch.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, ROWS):
            yield b.slice(k, ROWS)


def _summed(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], size: int, kind: str) -> np.ndarray:
    """The sum over all rows of of(x-vectors), a vector of `size`: added up in each task, then by position."""
    dtype = {"long": np.int64, "double": np.float64}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype)
        for b in _parts(batches):
            total += of(_matrix(b))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["at", "value"])

    added = map_arrow(rows.select("x"), run, f"at long, value {kind}").groupBy("at").agg(F.sum("value").alias("value"))
    out = np.zeros(size, dtype)
    for r in added.collect():
        out[r["at"]] = r["value"]
    return out


def scaled_deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n*x - S, exact."""
    return x * np.int64(n) - sums


def deviations(scaled: np.ndarray) -> list[int] | np.ndarray:
    """The sum of squares of each row, exact: as Python's integers where longs might not hold it."""
    most = int(np.abs(scaled).max(initial=0))
    if most * most * max(scaled.shape[1], 1) < 1 << 63:
        return (scaled * scaled).sum(axis=1)
    return [sum(int(v) ** 2 for v in row) for row in scaled]


def _squares(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """The sum of all deviations over n squared."""
    return np.array([np.sum(deviations(scaled_deviations(x, n, sums)), dtype=np.float64) / n**2])


def _times(x: np.ndarray, n: int, sums: np.ndarray, block: np.ndarray) -> np.ndarray:
    """X'(X block) of the centred rows, flat."""
    centred = scaled_deviations(x, n, sums) / n
    return (centred.T @ (centred @ block)).ravel()


def orthonormal(new: np.ndarray, basis: np.ndarray, rng: np.random.Generator, scale: float) -> np.ndarray:
    """New columns made orthonormal to the basis and to each other, each twice; one that vanishes is replaced by a random one, as long as there are dimensions left."""
    dim = len(new)
    for column in new.T:
        if basis.shape[1] >= dim:
            break
        least = 1e-10 * scale
        while True:
            before = np.linalg.norm(column)
            for _ in range(3):
                column = column - basis @ (basis.T @ column)
            after = np.linalg.norm(column)
            if after > least and after > 1e-8 * before:
                basis = np.column_stack([basis, column / after])
                break
            column, least = rng.standard_normal(dim), 0.0
    return basis


def block_lanczos(product: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int, block: int = BLOCK, residual: float = RESIDUAL, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues of a symmetric positive operator, falling, and their unit vectors as columns.

    product(block) multiplies. It stops when every wanted pair's residual is at most `residual` of the largest eigenvalue,
    or when the basis spans the whole space, which makes the pairs exact but for rounding."""
    rng = np.random.default_rng(seed)
    wanted, block = min(wanted, dim), min(block, dim)
    basis = orthonormal(rng.standard_normal((dim, block)), np.empty((dim, 0)), rng, 0.0)
    images = np.empty((dim, 0))
    while True:
        images = np.column_stack([images, product(basis[:, images.shape[1] :])])
        h = basis.T @ images
        values, vectors = np.linalg.eigh((h + h.T) / 2)
        values, vectors = values[::-1][:wanted], vectors[:, ::-1][:, :wanted]
        found = basis @ vectors
        left = np.linalg.norm(images @ vectors - found * values, axis=0)
        largest = max(values[0], 0.0)
        if basis.shape[1] >= dim or (basis.shape[1] >= wanted + block and left.max() <= residual * largest):
            return values, found / np.linalg.norm(found, axis=0)
        last = images[:, -block:]
        basis = orthonormal(last, basis, rng, largest)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each vector that takes part and each component.

    Which vectors take part: see whole_vectors. A component whose eigenvalue is none (under NO_VARIANCE of the largest)
    is left out, so there are at most as many as the rank: of one vector, or of copies of one, no rows come back. Null and
    repeated ids are rows like any other, and so are repeated vectors; other columns are ignored, whatever their names;
    no rows in, none out. A deviation that no long holds is an error."""
    rows = materialize(whole_vectors(vectors), "vectors")
    first = rows.select(F.size("x").alias("dim")).first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    none = rows.sparkSession.createDataFrame([], schema)
    if first is None:
        return none
    dim = first["dim"]
    counted = _summed(rows, lambda x: np.append(x.sum(axis=0), len(x)), dim + 1, "long")
    n, sums = int(counted[-1]), counted[:-1]
    trace = float(_summed(rows, partial(_squares, n=n, sums=sums), 1, "double")[0]) / n
    if trace == 0.0:
        return none
    product = lambda block: _summed(rows, partial(_times, n=n, sums=sums, block=block), block.size, "double").reshape(block.shape) / n
    values, axes = block_lanczos(product, dim, components)
    kept = values > NO_VARIANCE * values[0]
    values, axes = values[kept], axes[:, kept]
    k, to_white = len(values), axes / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        white = (scaled_deviations(x, n, sums) / n) @ to_white
        return np.concatenate([white.sum(axis=0), (white.T @ white).ravel()])

    seen = _summed(rows, moments, k + k * k, "double") / n
    identity_error = float(np.abs(seen[k:].reshape(k, k) - np.outer(seen[:k], seen[:k]) - np.eye(k)).max())
    explained = values / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            scaled = scaled_deviations(_matrix(b), n, sums)
            size = len(scaled)
            each = pa.array(np.repeat(np.arange(size), k))
            yield pa.RecordBatch.from_arrays([
                b.column("vec_id").cast(pa.int64()).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)), pa.array(np.full(size * k, n)),
                pa.array(deviations(scaled), pa.int64()).take(each), pa.array(((scaled / n) @ to_white).ravel()), pa.array(np.tile(explained, size)), pa.array(np.full(size * k, identity_error)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return map_arrow(rows, run, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of embeddings, whitened by the leading components."""
    return whiten(table(spark, sf_dir, "embeddings"))
