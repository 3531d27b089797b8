"""Approximate nearest neighbours by multiprobe p-stable hashing of unit vectors.

Vectors go to one bucket in each table; a query goes to its own bucket and to perturbed ones, in the
order of their estimated success. Queries and vectors meet by table and bucket only, what the tables
find is merged, and the candidates are ranked by the exact cosine. Buckets are dealt to parts of bounded
size; a bucket larger than a part is split, and its queries go to each piece.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import map_arrow, materialize, mix, table

#: Tables, width of a bucket (unit vectors), most probes a table, and the recall on the sample that sets the number of functions and of probes.
TABLES, WIDTH, MOST_PROBES, AIM = 8, 2.0, 4096, 0.93
#: The fit's sample: so many queries, whose true neighbours are looked up among all vectors.
SAMPLE_QUERIES = 200
#: Entries (a vector in a table) of a part, and most buckets that are split (the limit of size rises until so many are left).
PART_ENTRIES, MOST_SPLIT = 60_000, 10_000
#: Pairs of a query and a candidate that a task looks at together.
PAIRS = 400_000
RESULT = "query_id long, vec_id long, score double"


def unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(1, keepdims=True) if len(x) else x
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True)) if len(x) else x


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision, scaled first so that no square overflows; the same two vectors always give the same number."""
    a, b = (x / np.abs(x).max(1, keepdims=True) if len(x) else x for x in (a, b))
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def perturbations(functions: int, most: int) -> np.ndarray:
    """Sets of sides to cross, one a row, in the order of their expected cost; column j stands for the side of j-th smallest distance of a query.

    The expected squared distance of the j-th of 2m sides is known in closed form; sets are drawn from a
    heap by adding the next side or moving the last one on. A function's two sides are never crossed both.
    """
    m, n = functions, 2 * functions
    cost = [j * (j + 1) / (4 * (m + 1) * (m + 2)) if j <= m else 1 - (n + 1 - j) / (m + 1) + (n + 1 - j) * (n + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(1, n + 1)]
    heap, out = [(cost[0], (0,))], [()]
    while heap and len(out) < most:
        c, s = heapq.heappop(heap)
        if not any(n - 1 - j in s for j in s):
            out.append(s)
        last = s[-1]
        if last + 1 < n:
            heapq.heappush(heap, (c - cost[last] + cost[last + 1], (*s[:-1], last + 1)))
            heapq.heappush(heap, (c + cost[last + 1], (*s, last + 1)))
    sets = np.zeros((len(out), n), np.uint64)
    for i, s in enumerate(out):
        sets[i, list(s)] = 1
    return sets


class Tables:
    def __init__(self, dim: int, functions: int, seed: int = 7):
        rng = np.random.RandomState(seed)
        self.project, self.shift = rng.randn(TABLES, dim, functions), rng.rand(TABLES, functions) * WIDTH
        self.dim, self.functions = dim, functions
        self.salt = mix(np.arange(1, functions + 1, dtype=np.uint64))
        self.sets = perturbations(functions, MOST_PROBES)

    def _raw(self, x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        place = (x @ self.project[t] + self.shift[t]) / WIDTH
        cell = np.floor(place)
        return place - cell, (cell.astype(np.int64).view(np.uint64) * self.salt).sum(1, dtype=np.uint64) + np.uint64(t * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)

    def keys(self, x: np.ndarray) -> np.ndarray:
        """The bucket of each vector in each table."""
        return np.column_stack([mix(self._raw(x, t)[1]) for t in range(TABLES)])

    def probes(self, x: np.ndarray, t: int) -> np.ndarray:
        """The buckets of a table that each query visits, in order."""
        f, raw = self._raw(x, t)
        away = np.concatenate([f, 1 - f], axis=1)
        step = np.concatenate([np.uint64(0) - self.salt, self.salt])[np.argsort(away, axis=1, kind="stable")]
        return mix(raw[:, None] + step @ self.sets.T)


def _bests(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, ties to smaller ids; a pair counts once."""
    order = np.lexsort((ids, -score, q))
    q, ids, score = q[order], ids[order], score[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])
    q, ids, score = q[new], ids[new], score[new]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], ids[keep], score[keep]


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def distinct_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """(embedding, ids): each vector once, with its k + 1 smallest ids (one may be the query's own)."""
    order = Window.partitionBy("embedding").orderBy("vec_id")
    few = vectors.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)
    return few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def fit(distinct: DataFrame, dim: int, n: int, k: int = 5, aim: float = AIM, seed: int = 7) -> Tables:
    """Tables for the n distinct vectors of length dim: as many functions, and then as few probes, as reach `aim` recall of the k nearest for a sample of SAMPLE_QUERIES queries; their neighbours are looked up among all vectors."""
    most = max(4, min(24, int(n).bit_length() - 1))
    part = F.pmod(F.xxhash64("embedding"), F.lit(1_000_003)) / 1_000_003
    x = np.array([r[0] for r in distinct.where(part < min(1.0, 2 * SAMPLE_QUERIES / max(n, 1))).select("embedding").orderBy("embedding").limit(4 * SAMPLE_QUERIES).collect()], float).reshape(-1, dim)
    x = unit(x[np.random.RandomState(seed).permutation(len(x))[:SAMPLE_QUERIES]])
    if n <= k + 1 or not len(x):
        return Tables(dim, most, seed)
    held = distinct.sparkSession.sparkContext.broadcast(x)

    def nearest_of_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = unit(_matrix(b, dim))
            s = held.value @ v.T
            s[s > 1 - 1e-9] = -2  # itself
            m = min(k, len(v))
            top = np.argpartition(-s, m - 1, axis=1)[:, :m]
            q = np.repeat(np.arange(len(s)), m)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(s[q, top.ravel()]), b.column("embedding").take(pa.array(top.ravel()))], ["q", "s", "embedding"])

    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "embedding"))
    rows = map_arrow(distinct.select("embedding"), nearest_of_sample, "q long, s double, embedding array<double>").withColumn("rank", rank).where(F.col("rank") <= k).collect()
    q, near = np.array([r["q"] for r in rows]), unit(np.array([r["embedding"] for r in rows], float))
    for functions in range(most, 3, -2):
        out = Tables(dim, functions, seed)
        own, found = out.keys(near), np.full(len(q), MOST_PROBES)
        for t in range(TABLES):
            hit = out.probes(x, t)[q] == own[:, t : t + 1]
            found = np.minimum(found, np.where(hit.any(1), hit.argmax(1), MOST_PROBES))
        enough = [p for p in (1 << i for i in range(3, 13)) if (found < p).mean() >= aim]
        if enough or functions <= 5:
            out.sets = out.sets[: enough[0] if enough else MOST_PROBES]
            return out
    return out


def _packed(rows: DataFrame, side: int, tables: Tables | None, parts: int, split: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Rows (ids, embedding) dealt to parts, packed: the buckets, the row of each, and the rows. side 0: vectors, 1: queries. Without tables queries go to all parts and meet all vectors, which are dealt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024 if side == 0 else 128):
                yield from deal(b.slice(at, 1024 if side == 0 else 128))

    def deal(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = np.array(b.column("embedding").to_pylist(), float).reshape(b.num_rows, -1)
        ids = b.column("ids").to_pylist()
        number = mix(np.array([i[0] for i in ids], np.int64).view(np.uint64))
        if tables is None:
            keys = np.zeros(len(x) * (1 if side == 0 else parts), np.uint64)
            owner = np.tile(np.arange(len(x)), 1 if side == 0 else parts)
            part = (number % np.uint64(parts)).astype(np.int64) if side == 0 else np.repeat(np.arange(parts), len(x))
        else:
            u = unit(x)
            found = tables.keys(u) if side == 0 else np.concatenate([tables.probes(u, t) for t in range(TABLES)], axis=1)
            keys, owner = found.ravel(), np.repeat(np.arange(len(x)), found.shape[1])
            pieces = np.ones(len(keys), np.int64)
            if len(split[0]):
                place = np.minimum(np.searchsorted(split[0], keys), len(split[0]) - 1)
                pieces = np.where(split[0][place] == keys, split[1][place], 1)
            if side == 0:
                piece = (number[owner] % pieces.astype(np.uint64)).astype(np.int64)
            else:
                keys, owner, piece = np.repeat(keys, pieces), np.repeat(owner, pieces), np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            part = ((keys % np.uint64(parts)).astype(np.int64) + piece) % parts
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(parts + 1))
        for k in range(parts):
            r = order[cut[k] : cut[k + 1]]
            if len(r):
                own, local = np.unique(owner[r], return_inverse=True)
                sizes = np.array([len(ids[i]) for i in own], "<u4")
                flat = np.array([v for i in own for v in ids[i]], np.int64)
                blobs = (keys[r], local.astype("<u4"), sizes, flat, x[own])
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([side], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in blobs)], ["part", "side", "keys", "owners", "sizes", "ids", "vectors"])

    return map_arrow(rows.select("ids", "embedding"), run, "part int, side int, keys binary, owners binary, sizes binary, ids binary, vectors binary")


def _met(packed: DataFrame, dim: int, k: int) -> DataFrame:
    """The k best of each query in each part, among the vectors of the buckets it visits there."""

    def side(t: pa.Table, which: int) -> tuple[np.ndarray, ...]:
        rows = t.filter(pa.compute.equal(t.column("side"), which))
        read = lambda c, kind: [np.frombuffer(v, kind) for v in rows.column(c).to_pylist()] or [np.empty(0, kind)]
        sizes = read("sizes", "<u4")
        base = np.cumsum([0] + [len(s) for s in sizes[:-1]])
        owner = np.concatenate([o.astype(np.int64) + at for o, at in zip(read("owners", "<u4"), base, strict=True)])
        return np.concatenate(read("keys", np.uint64)), owner, np.concatenate(sizes).astype(np.int64), np.concatenate(read("ids", np.int64)), np.concatenate(read("vectors", float)).reshape(-1, dim)

    def run(t: pa.Table) -> pa.Table:
        (keys, owner, sizes, ids, x), (asked, asker, _, query_ids, q) = side(t, 0), side(t, 1)
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        lo, hi = np.searchsorted(keys, asked), np.searchsorted(keys, asked, side="right")
        some = np.flatnonzero(hi > lo)
        some = some[np.argsort(asker[some], kind="stable")]
        asker, lo, n = asker[some], lo[some], (hi - lo)[some]
        ux, uq, begin = unit(x).astype(np.float32), unit(q).astype(np.float32), np.cumsum(sizes) - sizes
        total = np.cumsum(n)
        at = 0
        while at < len(n):  # a visit at least, and of more as many as are few pairs
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")))
            size = n[at:end]
            row = owner[np.repeat(lo[at:end] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            pair = np.unique(np.repeat(asker[at:end], size) * len(ux) + row)
            who, row = pair // len(ux), pair % len(ux)
            rough = np.concatenate([np.einsum("ij,ij->i", uq[who[i : i + 65_536]], ux[row[i : i + 65_536]]) for i in range(0, len(who), 65_536)])
            order = np.lexsort((-rough, who))
            w, s = who[order], rough[order]
            first = np.searchsorted(w, w)
            last = np.minimum(first + k, np.searchsorted(w, w, side="right") - 1)
            keep = order[s >= s[last] - 1e-5]
            who, row = who[keep], row[keep]
            score, count = cosines(q[who], x[row]), sizes[row]
            found = ids[np.repeat(begin[row] - np.cumsum(count) + count, count) + np.arange(count.sum())]
            who, score = np.repeat(query_ids[who], count), np.repeat(score, count)
            other = found != who
            best = _bests(*(np.concatenate(z) for z in zip(best, (who[other], found[other], score[other]), strict=True)), k)
            at = end
        return pa.table({"query_id": pa.array(best[0]), "vec_id": pa.array(best[1]), "score": pa.array(best[2])})

    ship(packed.sparkSession)
    return packed.groupBy("part").applyInArrow(run, RESULT)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def split_buckets(distinct: DataFrame, tables: Tables, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of more than a part's vectors, sorted, and their numbers of pieces."""
    least = max(PART_ENTRIES // 4, n * TABLES // MOST_SPLIT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, n = np.unique(tables.keys(unit(_matrix(b, tables.dim))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])

    rows = map_arrow(distinct.select("embedding"), run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > least).collect()
    keys, pieces = np.array([r["key"] for r in rows], np.int64).view(np.uint64), np.array([-(-r["n"] // least) for r in rows], np.int64)
    order = np.argsort(keys)
    return keys[order], pieces[order]


def nearest(vectors: DataFrame, is_query, k: int = 5, aim: float = AIM) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k nearest vectors by cosine, nearest first, ties to the smaller vec_id.

    is_query is a condition on vec_id. Vectors that are null, zero or hold null or non-finite numbers take
    no part, nor do rows without vec_id; vectors of each length are searched among themselves. Rows of the
    query's own vec_id are no candidates; rows that repeat another vec_id count once, with the best; a
    query whose vec_id repeats asks with its largest vector. Equal vectors are one candidate that stands
    for its smallest ids. All candidates are returned if there are fewer than k, and a query for which the
    tables find fewer than k is searched again among all vectors. Nothing in, nothing out; other columns
    are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    good = good.where("forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) AND exists(embedding, x -> x <> 0)")
    asked = good.where(is_query).groupBy("vec_id").agg(F.max("embedding").alias("embedding")).select(F.array("vec_id").alias("ids"), "embedding")
    every = materialize(distinct_vectors(good, k), "vectors")
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in every.groupBy(F.size("embedding").alias("dim")).count().orderBy("dim").collect():
        dim, n = r["dim"], r["count"]
        own = every.where(F.size("embedding") == dim)
        queries = asked.where(F.size("embedding") == dim)
        tables, parts = fit(own, dim, n, k, aim), max(1, -(-n * TABLES // PART_ENTRIES))
        split = split_buckets(own, tables, n)
        packed = _packed(own, 0, tables, parts, split).unionByName(_packed(queries, 1, tables, parts, split))
        found = materialize(_ranked(_met(packed, dim, k), k), "neighbours")
        full = found.where(F.col("rank") == k).select("query_id")
        short = materialize(queries.join(full, F.col("query_id") == F.col("ids")[0], "left_anti"), "short")
        if short.limit(1).count():
            parts = max(1, -(-n // PART_ENTRIES))
            again = _ranked(_met(_packed(own, 0, None, parts, split).unionByName(_packed(short, 1, None, parts, split)), dim, k), k)
            found = found.join(full, "query_id", "left_semi").unionByName(again)
        out = out.unionByName(found)
    return out


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
