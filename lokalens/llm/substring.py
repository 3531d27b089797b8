"""Substring dedup: windows of words that occur again, found by FM-indexes of shards.

Equal windows choose the same anchor (the smallest hash among their runs of a few words), so what can
repeat meets by anchor: stretches around anchors that occur once are never sent anywhere. The other
stretches go to the shard of their anchor, each distinct one once with its count. They are indexed there
and streamed against the index; what its matching statistics report is carried back to the documents.
An anchor with many different stretches is split by the words next to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import WordHash, ids_of, map_arrow, materialize, ngram_hashes, slices, table, texts_of
from .fmindex import FMIndex
from .jaccard import _filter

WIDTH, ANCHOR = 35, 8
#: Anchor hashes of a shard of the count, words of a shard of the index (before equal stretches are put together).
SHARD_ANCHORS, SHARD_WORDS = 2_000_000, 2_000_000
#: An anchor of more different stretches is split, if it also has more than one in MOST_SPLIT of all: there are fewer of them than that.
STRETCHES, MOST_SPLIT = 4000, 65_536


def anchors(words: np.ndarray, width: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last, at, ends) of each anchor: the windows first..last, by start, are those that choose it; it stands at `at`; ends is a hash of the runs at both ends of the stretch. Empty if there is no window."""
    none = np.empty(0, np.int64)
    if len(words) < width:
        return none.astype(np.uint64), none, none, none, none.astype(np.uint64)
    h = ngram_hashes(words, anchor)
    span = width - anchor + 1
    starts = len(h) - span + 1
    # smallest hash of each stretch by doubling; the place of the leftmost is kept with it
    best, at, w = h, np.arange(len(h)), 1
    while w * 2 <= span:
        take = best[w:] < best[:-w]
        at = np.where(take, at[w:], at[:-w])
        best = np.where(take, best[w:], best[:-w])
        w *= 2
    gap = span - w
    left, right = best[:starts], best[gap : gap + starts]
    at = np.where(right < left, at[gap : gap + starts], at[:starts])
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], starts) - 1
    return h[at[first]], first, last, at[first], h[first] * np.uint64(0x9E3779B97F4A7C15) + h[last + span - 1]


def _pieces(first: int, last: int, at: int, width: int, anchor: int) -> list[tuple[int, int, int, int]]:
    """(first, last, begin, end): the windows of a stretch that hold more words behind the anchor and those that hold more before it, with the words that all of a part hold."""
    half = (width - anchor) // 2
    right, left = (max(first, at - half), last), (first, min(last, at - half - 1))
    return [(a, z, b, e) for (a, z), b, e in ((left, at - half - 1, at + anchor), (right, at, at - half + width)) if a <= z]


def _counts(docs: DataFrame, width: int, anchor: int, shards: int) -> DataFrame:
    """(node, n, kinds): the anchors that occur again, as longs, how often, and an upper bound of how many different stretches they have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, held, size = WordHash(), [], 0

        def out() -> Iterator[pa.RecordBatch]:
            h, ends = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((ends, h))
            h, ends = h[order], ends[order]
            new = np.concatenate([[True], h[1:] != h[:-1]])
            begin = np.flatnonzero(new)
            other = new.copy()
            other[1:] |= ends[1:] != ends[:-1]
            h, n, kinds = h[begin], np.diff(np.append(begin, len(h))), np.add.reduceat(other.astype(np.int64), begin)
            shard = (h >> np.uint64(20)) % np.uint64(shards)
            order = np.argsort(shard, kind="stable")
            cut = np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))
            for k in range(shards):
                rows = order[cut[k] : cut[k + 1]]
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (h[rows], n[rows].astype("<u4"), kinds[rows].astype("<u4")))], ["shard", "hashes", "counts", "kinds"])

        for b in slices(batches, 256):
            for t in texts_of(b):
                h, _, _, _, ends = anchors(memo.of(t.split()), width, anchor)
                if len(h):
                    held.append((h, ends))
                    size += len(h)
            if size > 2_000_000:
                yield from out()
                size = 0
        if held:
            yield from out()

    def add(t: pa.Table) -> pa.Table:
        h, n, kinds = (np.concatenate([np.frombuffer(x, kind) for x in t.column(c).to_pylist()]) for c, kind in (("hashes", np.uint64), ("counts", "<u4"), ("kinds", "<u4")))
        every, of = np.unique(h, return_inverse=True)
        total, kinds = (np.bincount(of, weights=x).astype(np.int64) for x in (n, kinds))
        again = total > 1
        return pa.table({"node": pa.array(every[again].view(np.int64)), "n": pa.array(total[again]), "kinds": pa.array(kinds[again])})

    packed = map_arrow(docs.select("text"), run, "shard int, hashes binary, counts binary, kinds binary")
    return packed.groupBy("shard").applyInArrow(add, "node long, n long, kinds long")


def _stretches(keyed: DataFrame, again: DataFrame, n_again: int, split: np.ndarray, shards: int, width: int, anchor: int) -> DataFrame:
    """Rows of two kinds: shard and packed distinct stretches of words; or a text's key and where its stretches lie. split: the sorted anchors to split."""
    held = keyed.sparkSession.sparkContext.broadcast((*_filter(again, n_again), split))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (filter_words, bits, split), memo, told = held.value, WordHash(), set()
        found: dict[tuple[int, int], list] = {}
        size = 0
        schema = pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary()), ("words", pa.binary()), ("k1", pa.int64()), ("k2", pa.int64()), ("s1", pa.list_(pa.int64())), ("s2", pa.list_(pa.int64())), ("at", pa.list_(pa.int32()))])

        def out() -> Iterator[pa.RecordBatch]:
            by: dict[int, list] = {}
            for key, v in found.items():
                by.setdefault(v[0], []).append((key, v))
            found.clear()
            for k, rows in by.items():
                keys = np.array([x for x, _ in rows], np.uint64).tobytes()
                sizes = np.array([len(v[2]) for _, v in rows], "<u4").tobytes()
                counts = np.array([v[1] for _, v in rows], "<u4").tobytes()
                words = np.concatenate([v[2] for _, v in rows]).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((k, keys, sizes, counts, words, None, None, None, None, None), schema, strict=True)], schema=schema)

        for b in slices(batches, 256):
            places = []
            for t, k1, k2 in zip(texts_of(b), b.column("k1").to_pylist(), b.column("k2").to_pylist(), strict=True):
                w = memo.of(t.split())
                h, first, last, stands, _ = anchors(w, width, anchor)
                if not len(h):
                    continue
                cell = np.mod(h.view(np.int64), bits)
                rows = np.flatnonzero(filter_words[cell >> 6] >> (cell & 63) & 1)
                if not len(rows):
                    continue
                short = (w >> np.uint64(32)).astype("<u4")
                s1, s2, begins = [], [], []
                parted = split[np.minimum(np.searchsorted(split, h[rows]), len(split) - 1)] == h[rows] if len(split) else np.zeros(len(rows), bool)
                parts = [(first[i], last[i], int(h[i] >> np.uint64(20))) for i in rows[~parted]]
                for i in rows[parted]:
                    parts += [(a, z, xxhash.xxh3_64_intdigest(w[b:e].tobytes())) for a, z, b, e in _pieces(first[i], last[i], stands[i], width, anchor)]
                for a, z, place in parts:
                    begins.append(int(a))
                    z += width
                    d = xxhash.xxh3_128_intdigest(w[a:z].tobytes())
                    key = (d >> 64, d & 0xFFFFFFFFFFFFFFFF)
                    s1.append(key[0] - (1 << 63))
                    s2.append(key[1] - (1 << 63))
                    if (v := found.get(key)) is None:
                        found[key] = [place % shards, 1, short[a:z]]
                        size += z - a
                    else:
                        v[1] += 1
                if (k1, k2) not in told:
                    if len(told) < 200_000:
                        told.add((k1, k2))
                    places.append((k1, k2, s1, s2, begins))
            if places:
                nothing = [None] * len(places)
                yield pa.RecordBatch.from_arrays([pa.array(nothing if i < 5 else [p[i - 5] for p in places], f.type) for i, f in enumerate(schema)], schema=schema)
            if size > 2_000_000:
                yield from out()
                size = 0
        yield from out()

    return map_arrow(keyed, run, "shard int, keys binary, sizes binary, counts binary, words binary, k1 long, k2 long, s1 array<long>, s2 array<long>, at array<int>")


def _search(packed: DataFrame, width: int) -> DataFrame:
    """(s1, s2, mask): the stretches with windows that occur again and those windows."""

    def run(t: pa.Table) -> pa.Table:
        read = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in t.column(c).to_pylist()])
        keys, sizes, counts, words = read("keys", np.uint64).reshape(-1, 2), read("sizes", "<u4").astype(np.int64), read("counts", "<u4").astype(np.int64), read("words", "<u4")
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        k = keys[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]).any(1)])
        total = np.add.reduceat(counts[order], np.flatnonzero(new))
        one = order[new]
        begin = (np.cumsum(sizes) - sizes)[one]
        size = sizes[one]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
        index, masks = FMIndex(words[at], size, total), (np.int64(1) << (size - width + 1)) - 1
        once = total < 2  # others repeat as a whole
        masks[once] = index.repeated_windows(words[at[np.repeat(once, size)]], size[once], width)
        some = masks != 0
        kept = keys[one][some] ^ np.uint64(1 << 63)  # as the documents' rows have them
        return pa.table({"s1": pa.array(np.ascontiguousarray(kept[:, 0]).view(np.int64)), "s2": pa.array(np.ascontiguousarray(kept[:, 1]).view(np.int64)), "mask": pa.array(masks[some])})

    ship(packed.sparkSession)
    return packed.groupBy("shard").applyInArrow(run, "s1 long, s2 long, mask long")


def drop_repeats(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each text without the words of windows of `width` words that also start elsewhere.

    Words are the ASCII-white-space-free chunks, unchanged; kept ones are joined by one space. A window
    counts as repeated wherever else it starts, in the same text too, and is judged on the input. Null
    text has no words, a text of fewer than `width` words no window. Rows that repeat a doc_id are texts of their
    own, so equal rows of `width` words or more lose all of them. Other columns are ignored, whatever their
    names; no rows in, none out; long texts are read whole. Words are compared by 32-bit hashes, `width` of
    them at a time. width must be over anchor and at most anchor + 54. What many different stretches share
    is told apart by (width + anchor) / 2 words at least; a phrase that is longer still is one shard's.
    """
    if not anchor < width <= anchor + 54:
        raise ValueError("width must be over anchor and at most anchor + 54")
    key = [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), "text").alias("k2")]
    keyed = docs.select("text", *key)
    n = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    again = materialize(_counts(docs, width, anchor, max(1, int(n // 100 // SHARD_ANCHORS))), "anchors")
    n_again, uses, kinds = again.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    split = np.sort(np.array([r[0] for r in again.where((F.col("kinds") > STRETCHES) & (F.col("kinds") * MOST_SPLIT > kinds)).select("node").collect()], np.int64).view(np.uint64))
    found = materialize(_stretches(keyed, again.select("node"), n_again, split, max(1, uses * (width + 15) // SHARD_WORDS), width, anchor), "stretches")
    masks = materialize(_search(found.where("shard IS NOT NULL").select("shard", "keys", "sizes", "counts", "words"), width), "windows")
    places = found.where("shard IS NULL").select("k1", "k2", F.explode(F.arrays_zip("s1", "s2", "at")).alias("p")).select("k1", "k2", "p.s1", "p.s2", "p.at")
    hits = places.join(masks.hint("merge"), ["s1", "s2"]).groupBy("k1", "k2").agg(F.collect_set(F.struct("at", "mask")).alias("hits"))
    hits = materialize(hits.select(F.col("k1").alias("h1"), F.col("k2").alias("h2"), F.col("hits.at").alias("at"), F.col("hits.mask").alias("mask")), "hits")
    # hits grow with the documents, so small ones are not broadcast either: the plan is the same at every size
    joined = docs.select("doc_id", "text", *key).join(hits.hint("merge"), (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")), "left").select("doc_id", "text", "at", "mask")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            n_words, n_removed, kept = [], [], []
            for t, at, mask in zip(texts_of(b), b.column("at").to_pylist(), b.column("mask").to_pylist(), strict=True):
                words = t.split()
                n_words.append(len(words))
                if at:
                    m = np.array(mask, np.int64)
                    row, bit = np.nonzero(m[:, None] >> np.arange(62) & 1)
                    start = np.array(at, np.int64)[row] + bit
                    depth = np.bincount(start, minlength=len(words) + 1) - np.bincount(start + width, minlength=len(words) + 1)
                    gone = np.cumsum(depth)[: len(words)] > 0
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([pa.array(ids_of(b), pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return map_arrow(joined, run, "doc_id long, n_words long, n_removed long, kept string")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
