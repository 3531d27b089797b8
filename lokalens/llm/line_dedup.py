"""Line dedup: a sharded minimal perfect hash over line hashes, probed by the documents.

A line that occurs in one document only can never be dropped, so the index holds the hashes found in
two documents or more; any other line fails the fingerprint comparison at the slot it is sent to.
Keys are 128-bit hashes: one half chooses shard and slot, the other is the fingerprint. Each document's
line hashes go once to their shards, whatever the size of the index, and only hits come back. The few
lines that are frequent have an index of their own, of bounded size, that every task holds.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shipping import ship
from .common import NULL_ID, ids_of, map_arrow, materialize, mix, slices, table, texts_of

#: Keys a shard of the index holds on average, at about 30 bytes a key, and lines sent to it, at 44.
KEYS_PER_SHARD, LINES_PER_SHARD = 65_536, 1_000_000
#: A key with more than one in so many of the repeated lines is frequent: there are fewer of them than that.
FREQUENT = 65_536
_WHITE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    return line.strip(_WHITE).lower()


def _code_points(b: bytes) -> int:
    return len(b) if b.isascii() else len(b.decode("utf-8"))


def key_hash(key: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(key)
    return d >> 64, d & 0xFFFFFFFFFFFFFFFF


class PerfectHash:
    """Minimal perfect hash by levels: each level gives the keys that are alone in their cell a bit; the rest fall to the next. A key's slot is the rank of its bit."""

    def __init__(self, keys: np.ndarray, gamma: float = 1.6):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        base, left, level = 0, keys, 0
        while len(left):
            size = max(64, int(gamma * len(left)) + 1)
            cell = self._cell(left, level, size)
            alone = np.bincount(cell, minlength=size) == 1
            words = np.zeros((size + 63) // 64 * 64, np.uint8)
            words[:size] = alone
            bits = np.packbits(words, bitorder="little").view(np.uint64)
            rank = base + np.concatenate([[0], np.cumsum(words.reshape(-1, 64).sum(1))[:-1]]).astype(np.int64)
            self.levels.append((size, bits, rank.astype(np.uint32)))
            base += int(alone.sum())
            left, level = left[~alone[cell]], level + 1
        self.n = base

    @staticmethod
    def _cell(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key that was built in; any slot, or -1, for another."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (size, bits, rank) in enumerate(self.levels):
            if not len(todo):
                break
            cell = self._cell(keys[todo], level, size)
            word, off = bits[cell >> 6], (cell & 63).astype(np.uint64)
            hit = (word >> off) & np.uint64(1) == 1
            below = word & ((np.uint64(1) << off) - np.uint64(1))
            out[todo[hit]] = rank[cell[hit] >> 6].astype(np.int64) + np.bitwise_count(below[hit])
            todo = todo[~hit]
        return out


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, lo, hi, n): the qualifying keys with their smallest and largest document and their number, pre-aggregated by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[int]] = {}

        def out() -> pa.RecordBatch:
            k = np.array(list(held), np.uint64).reshape(-1, 2).view(np.int64)
            v = np.array(list(held.values()), np.int64).reshape(-1, 3)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (k[:, 0], k[:, 1], v[:, 0], v[:, 1], v[:, 2])], ["h1", "h2", "lo", "hi", "n"])

        for b in slices(batches):
            for doc, text in zip(ids_of(b), texts_of(b), strict=True):
                doc = NULL_ID if doc is None else doc
                for key in {line_key(x) for x in text.split(b"\n")}:
                    if len(key) >= min_chars and _code_points(key) >= min_chars:
                        h = key_hash(key)
                        if (v := held.get(h)) is None:
                            held[h] = [doc, doc, 1]
                        else:
                            v[0], v[1], v[2] = min(v[0], doc), max(v[1], doc), v[2] + 1
            if len(held) > 200_000:
                yield out()
        if held:
            yield out()

    return map_arrow(docs.select("doc_id", "text"), run, "h1 long, h2 long, lo long, hi long, n long")


def repeated_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, lo, n), written: the keys of at least two documents, the smallest of these and how many rows hold the key."""
    found = line_keys(docs, min_chars).groupBy("h1", "h2").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    return materialize(found.where("lo < hi").drop("hi"), "lines")


class Shard:
    """A shard of the index: the perfect hash of its keys with arrays of fingerprints, counts and first documents by slot."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, lo: np.ndarray, n: np.ndarray):
        # two keys with one first half (it takes 2^32 lines to expect any) would share a slot; the second goes to the rest
        one, first = np.unique(h1, return_index=True)
        self.hash = PerfectHash(one)
        at = self.hash.slots(one)
        self.prints, self.firsts, self.counts = np.zeros(len(one), np.uint64), np.zeros(len(one), np.int64), np.zeros(len(one), np.uint32)
        self.prints[at], self.firsts[at], self.counts[at] = h2[first], lo[first], np.minimum(n[first], 0xFFFFFFFF)
        self.rest = {(int(h1[i]), int(h2[i])): (int(lo[i]), int(n[i])) for i in np.setdiff1d(np.arange(len(h1)), first)}

    def first_documents(self, h1: np.ndarray, h2: np.ndarray, min_rows: int) -> np.ndarray:
        """The smallest document of each key; NULL_ID's negative for a key that the shard doesn't know or that fewer rows hold."""
        out = np.full(len(h1), -NULL_ID, np.int64)
        if len(self.prints) and len(h1):
            at = self.hash.slots(h1)
            ok = (at >= 0) & (self.prints[at] == h2) & (self.counts[at] >= min_rows)
            out[ok] = self.firsts[at[ok]]
        for i in range(len(h1)) if self.rest else ():
            lo, n = self.rest.get((int(h1[i]), int(h2[i])), (0, -1))
            if n >= min_rows:
                out[i] = lo
        return out


def _unsigned(columns: list) -> list[np.ndarray]:
    return [np.array(c, np.int64).view(np.uint64) for c in columns]


def build_index(found: DataFrame, shards: int) -> DataFrame:
    """(shard, blob), written: the shards of the keys in found."""

    def build(t: pa.Table) -> pa.Table:
        h1, h2 = _unsigned([t.column(c).to_numpy() for c in ("h1", "h2")])
        blob = pickle.dumps(Shard(h1, h2, t.column("lo").to_numpy(), t.column("n").to_numpy()), protocol=5)
        return pa.table({"shard": pa.array([t.column("shard")[0].as_py()], pa.int32()), "blob": pa.array([blob], pa.binary())})

    ship(found.sparkSession)
    keyed = found.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
    return materialize(keyed.groupBy("shard").applyInArrow(build, "shard int, blob binary"), "line-index")


def _lines(text: bytes, min_chars: int) -> tuple[list[bytes], list[int], list[tuple[int, int]]]:
    """The lines of a text; the numbers and the hashes of those whose keys are long enough."""
    lines, at, hashes = text.split(b"\n"), [], []
    for i, line in enumerate(lines):
        key = line_key(line)
        if len(key) >= min_chars and _code_points(key) >= min_chars:
            at.append(i)
            hashes.append(key_hash(key))
    return lines, at, hashes


def _probes(docs: DataFrame, frequent, min_chars: int, shards: int) -> DataFrame:
    """The line hashes of (d, text, k1, k2) dealt to shards, packed: those that aren't in the frequent index, with the row and the line they are of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[tuple[int, int]] = set()
        for b in slices(batches):
            hashes, at, owner = [], [], []
            row_keys = list(zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), strict=True))
            for i, (key, text) in enumerate(zip(row_keys, texts_of(b), strict=True)):
                if key in told:  # a row that is there again gets the same answer
                    continue
                if len(told) < 200_000:
                    told.add(key)
                _, own, found = _lines(text, min_chars)
                at += own
                hashes += found
                owner += [i] * len(own)
            if not hashes:
                continue
            h = np.array(hashes, np.uint64).reshape(-1, 2)
            known = frequent.value.first_documents(np.ascontiguousarray(h[:, 0]), np.ascontiguousarray(h[:, 1]), 0) != -NULL_ID
            h, at, owner = h[~known], np.array(at, "<u4")[~known], np.array(owner)[~known]
            shard = np.mod(h[:, 0].view(np.int64), shards)
            order = np.argsort(shard, kind="stable")
            columns = [h[:, 0], h[:, 1], *(np.array(b.column(c).to_pylist(), np.int64)[owner] for c in ("d", "k1", "k2")), at]
            cut = np.searchsorted(shard[order], np.arange(shards + 1)) if shards <= 4096 else None
            for k in np.unique(shard).tolist():
                lo, hi = (cut[k], cut[k + 1]) if cut is not None else np.searchsorted(shard[order], [k, k + 1])
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([np.ascontiguousarray(c[order[lo:hi]]).tobytes()], pa.binary()) for c in columns)], ["shard", "h1", "h2", "d", "k1", "k2", "at"])

    return map_arrow(docs, run, "shard int, h1 binary, h2 binary, d binary, k1 binary, k2 binary, at binary")


def _hits(index: DataFrame, probes: DataFrame, min_rows: int) -> DataFrame:
    """(k1, k2, at): the lines to drop, by row, that the shards know."""

    def run(t: pa.Table) -> pa.Table:
        blobs = [x for x in t.column("blob").to_pylist() if x is not None]
        read = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in t.column(c).to_pylist() if x is not None] or [np.empty(0, kind)])
        first = np.full(0, -NULL_ID)
        if blobs:
            first = pickle.loads(blobs[0]).first_documents(read("h1", np.uint64), read("h2", np.uint64), min_rows)
        hit = np.flatnonzero((first != -NULL_ID) & (first != read("d", np.int64)[: len(first)]))
        return pa.table({"k1": pa.array(read("k1", np.int64)[hit]), "k2": pa.array(read("k2", np.int64)[hit]), "at": pa.array(read("at", "<u4")[hit].astype(np.int32))})

    ship(index.sparkSession)
    both = probes.unionByName(index, allowMissingColumns=True)
    return both.groupBy("shard").applyInArrow(run, "k1 long, k2 long, at int")


def _judged(docs: DataFrame, min_chars: int, keys_per_shard: int, lines_per_shard: int, min_rows: int) -> DataFrame:
    """The rows of docs under the names c0, c1, ... with the dropped lines gone from the text, and the columns lines and dropped."""
    spark, names = docs.sparkSession, docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    rows = docs.toDF(*inner)
    doc, text = (f"c{names.index(c)}" for c in ("doc_id", "text"))
    rows = rows.withColumn(doc, F.col(doc).cast("long")).withColumn(text, F.col(text).cast("string"))
    pair = rows.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    found = repeated_keys(pair, min_chars)
    keys, held = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    often = F.col("n") * FREQUENT > held
    common = found.where(often).collect()  # fewer than FREQUENT
    h1, h2 = _unsigned([[r[c] for r in common] for c in ("h1", "h2")])
    frequent = spark.sparkContext.broadcast(Shard(h1, h2, np.array([r["lo"] for r in common], np.int64), np.array([r["n"] for r in common], np.int64)))
    lines = pair.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    shards = max(1, -(-keys // keys_per_shard), -(-lines // lines_per_shard))
    keyed = rows.withColumns({"d": F.coalesce(doc, F.lit(NULL_ID)), "k1": F.xxhash64(doc, text), "k2": F.xxhash64(F.lit(7), doc, text)})
    probes = _probes(keyed.where(F.col(text).isNotNull()).select("d", F.col(text).alias("text"), "k1", "k2"), frequent, min_chars, shards)
    hits = _hits(build_index(found.where(~often), shards), probes, min_rows)
    hits = materialize(hits.groupBy(F.col("k1").alias("h1"), F.col("k2").alias("h2")).agg(F.collect_set("at").alias("gone")), "hits")
    # hits grow with the documents, so small ones are not broadcast either: the plan is the same at every size
    joined = keyed.join(hits.hint("merge"), (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")), "left").select(*inner, "d", "gone")
    schema = StructType([*rows.schema, *StructType.fromDDL("lines long, dropped long")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n_lines, n_dropped, kept = [], [], []
            for d, raw, gone in zip(b.column("d").to_pylist(), texts_of(b, text), b.column("gone").to_pylist(), strict=True):
                lines, at, hashes = _lines(raw, min_chars)
                go = set(gone or ())
                if hashes:
                    h = np.array(hashes, np.uint64)
                    first = frequent.value.first_documents(np.ascontiguousarray(h[:, 0]), np.ascontiguousarray(h[:, 1]), min_rows)
                    go.update(at[i] for i in np.flatnonzero((first != -NULL_ID) & (first != d)))
                n_lines.append(len(lines))
                n_dropped.append(len(go))
                kept.append(b"\n".join(x for i, x in enumerate(lines) if i not in go) if go else raw)
            columns = {c: b.column(c) for c in inner} | {text: pa.array(kept, pa.binary()).cast(pa.string())}
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*columns, "lines", "dropped"])

    return map_arrow(joined, run, schema)


def line_dedup(docs: DataFrame, min_chars: int = 10, keys_per_shard: int = KEYS_PER_SHARD, lines_per_shard: int = LINES_PER_SHARD, min_rows: int = 2) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): each document without the lines that a document of smaller id has too.

    A line's key is the line stripped of ASCII white space, A-Z lower-cased; keys under min_chars code
    points are always kept, and so are those that fewer than min_rows rows hold. Null or empty text is one
    empty line; texts are read whole, however long. Rows that repeat a doc_id count as the same document, a
    null doc_id as one document larger than all. Other columns are ignored, whatever their names. No rows
    in, none out.
    """
    out = _judged(docs.select("doc_id", "text"), min_chars, keys_per_shard, lines_per_shard, min_rows)
    return out.select(F.col("c0").alias("doc_id"), F.col("lines").alias("n_lines"), F.col("dropped").alias("n_dropped"), F.col("c1").alias("kept"))


def without_repeated_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """The rows of docs, all columns, with the text that line_dedup() keeps; a null text becomes an empty one, n_chars is counted anew where it is there."""
    out = _judged(docs, min_chars, KEYS_PER_SHARD, LINES_PER_SHARD, 2)
    text = f"c{docs.columns.index('text')}"
    return out.select(*((F.length(text).cast("long") if c == "n_chars" else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT doc_id, line, pos,
        translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS lo FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.doc_id, k.line, k.pos, (f.lo IS NOT NULL AND f.lo <> k.doc_id) AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
