"""N-gram Jaccard join by partitions of the universe.

Shingles are hashed into segments, as many as suit a band of set sizes. Two sets of Jaccard 3/4 or more
differ in at most a seventh of their sizes' sum, so most segments hold equal subsets, and the pigeonhole
says how many must agree. A set's budget goes to its cheapest subsets: those that no other set has
cost nothing, then the rarest; frequent and empty ones get none. Sets too crowded for that budget also
index the neighbours of their subsets with one element left out. What meets is verified exactly: a large
group is dealt to blocks, each with a few pivots of the group, and only what the pivots don't connect
meets the other blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordHash, ids_of, map_arrow, materialize, mix, ngram_hashes, release, slices, table, texts_of
from .components import components
from ..shipping import ship

SHINGLE = 5
#: Signatures of a shard of the index; shingles of a block of a group and sets of the group that each of its blocks gets; shingles of a part of what these leave open.
SHARD_SIGNATURES, BLOCK_SHINGLES, PIVOTS, PART_SHINGLES = 1_500_000, 20_000, 8, 2_000_000
#: Most bits of the filter of candidates (32 MB), and bits of one of its pages.
FILTER_BITS, PAGE_BITS = 1 << 28, 1 << 16
_ALL = 1 << 30


def shingles(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of n words; of fewer words, the one hash of them all."""
    if 0 < len(words) < n:
        return mix(ngram_hashes(words, len(words)) + np.uint64(len(words)))
    return np.unique(ngram_hashes(words, n))


def set_key(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def sets_of(batch: pa.RecordBatch, memo: WordHash, n: int) -> list[np.ndarray]:
    return [shingles(memo.of(t.lower().split()), n) for t in texts_of(batch)]


def linked(common: int, a: int, b: int) -> bool:
    return 100 * common >= 75 * (a + b - common)


def signatures(s: np.ndarray) -> list[tuple[int, int, int, np.ndarray]]:
    """(role, need, nonempty, signatures) of a set: for its own band (role 0) and, if a smaller partner may lie in it, the band below (1).

    Band k takes pairs whose smaller set has 2^k to 2^(k+1) - 1 elements; it has 2^k segments. A set's
    need is the most that a partner can differ, and one. A set with no more filled segments than that
    gets a second list (roles 2 and 3) of its subsets with and without each element, all of it to be met.
    """
    n, out = len(s), []
    top = n.bit_length() - 1
    low = (3 * n + 3) // 4
    inner = mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    for role, band in enumerate(range(top, low.bit_length() - 2, -1)):
        m = 1 << band
        need = 1 + (n // 3 if role == 0 else (m * 2 - 1 + n) // 7)
        seg = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        begin = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
        content = np.add.reduceat(inner, begin)
        tag = (seg[begin] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((band + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
        out.append((role, need, len(begin), mix(content ^ mix(tag))))
        if len(begin) < need:
            size = np.diff(np.append(begin, n))
            of = np.repeat(np.arange(len(begin)), size)
            many = size[of] > 1
            less = mix((content[of] - inner)[many] ^ mix(tag[of][many] + np.uint64(3)))
            both = np.concatenate([mix(content ^ mix(tag + np.uint64(3))), less])
            if (size == 1).sum() + 2 * (size > 1).sum() < need:  # nearly all in one segment: such sets of a band all meet
                both = np.append(both, mix(np.array([band + 99], np.uint64)))
            out.append((role + 2, _ALL, len(both), both))
    return out


def digest(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, node): the size of each row's set and a hash that equal sets share; node is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        for b in slices(batches):
            sets = sets_of(b, memo, n)
            yield pa.RecordBatch.from_arrays([pa.array(ids_of(b), pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) if len(s) else None for s in sets], pa.int64())], ["doc_id", "n_shingles", "node"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_shingles long, node long")


def _index(docs: DataFrame, n: int, shards: int) -> DataFrame:
    """Signatures dealt to shards, packed: for a run of documents and a shard the low halves of the signatures with the entries (a set in a band) they are of, twelve bytes each; and what is to be known of the entries whose home the shard is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, seen = WordHash(), set()
        entries: list[tuple[int, int, int]] = []
        sigs: list[np.ndarray] = []
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            flat, meta = np.concatenate(sigs), np.array(entries, np.int64)
            ids = mix(meta[:, 0].view(np.uint64) + (meta[:, 1].view(np.uint64) & np.uint64(3)))
            owner = np.repeat(ids, [len(x) for x in sigs])
            shard, home = ((x >> np.uint64(32)) % np.uint64(shards) for x in (flat, ids))
            order, at_home = np.argsort(shard, kind="stable"), np.argsort(home, kind="stable")
            cut, home_cut = (np.searchsorted(x[o], np.arange(shards + 1, dtype=np.uint64)) for x, o in ((shard, order), (home, at_home)))
            low = flat.astype("<u4")
            for k in range(shards):
                rows, own = order[cut[k] : cut[k + 1]], at_home[home_cut[k] : home_cut[k + 1]]
                if len(rows) or len(own):
                    blobs = [meta[own].tobytes(), ids[own].tobytes(), owner[rows].tobytes(), low[rows].tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs)], ["shard", "homes", "home_ids", "entries", "sigs"])
            entries.clear()
            sigs.clear()

        for b in slices(batches, 256):
            for s in sets_of(b, memo, n):
                if not len(s) or (key := set_key(s)) in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(key)
                for role, need, filled, sig in signatures(s):
                    entries.append((key, role | need << 2, filled))
                    sigs.append(sig)
                    held += len(sig)
            if held > 500_000:
                yield from out()
                held = 0
        if sigs:
            yield from out()

    return map_arrow(docs.select("doc_id", "text"), run, "shard int, homes binary, home_ids binary, entries binary, sigs binary")


def _read(t: pa.Table, column: str, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in t.column(column).to_pylist()]


def _shared(packed: DataFrame, parts: int) -> DataFrame:
    """Packed by part (of the entries): a shard's signatures that occur again, each with its number and its entry; and what is known of the part's entries."""

    def run(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        own, first = np.unique(np.concatenate(_read(t, "home_ids", np.uint64)), return_index=True)
        homes = np.concatenate(_read(t, "homes", np.int64)).reshape(-1, 3)[first]
        sig, entry = np.concatenate(_read(t, "sigs", "<u4")), np.concatenate(_read(t, "entries", np.uint64))
        order = np.lexsort((entry, sig))
        sig, entry = sig[order], entry[order]
        if len(sig):  # a set that several tasks have seen comes from each: once is enough
            new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (entry[1:] != entry[:-1])])
            sig, entry = sig[new], entry[new]
        begin = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.empty(0, np.int64)
        size = np.diff(np.append(begin, len(sig)))
        often = np.repeat(size, size)
        rows = np.flatnonzero(often > 1)
        what, who, freq = sig[rows], entry[rows], np.minimum(often[rows], 0xFFFFFFFF).astype("<u4")
        part = ((who >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(parts + 1))
        release()
        out = [(shard, shard, homes.tobytes(), own.tobytes(), b"", b"", b"")]
        for k in range(parts):
            r = order[cut[k] : cut[k + 1]]
            if len(r):
                out.append((k, shard, b"", b"", who[r].tobytes(), freq[r].tobytes(), what[r].tobytes()))
        names = ["part", "shard", "homes", "home_ids", "entries", "freqs", "sigs"]
        return pa.table({n: pa.array([r[i] for r in out], pa.int32() if i < 2 else pa.binary()) for i, n in enumerate(names)})

    ship(packed.sparkSession)
    return packed.groupBy("shard").applyInArrow(run, "part int, shard int, homes binary, home_ids binary, entries binary, freqs binary, sigs binary")


def _spent(shared: DataFrame) -> DataFrame:
    """(node, sig): what each entry's budget buys, its rarest repeated signatures; none if fewer repeat than a partner must share."""

    def run(t: pa.Table) -> pa.Table:
        ids, home = np.unique(np.concatenate(_read(t, "home_ids", np.uint64)), return_index=True)
        entry = np.concatenate(_read(t, "homes", np.int64)).reshape(-1, 3)[home]
        of = np.searchsorted(ids, np.concatenate(_read(t, "entries", np.uint64)))
        freq = np.concatenate(_read(t, "freqs", "<u4"))
        sig = np.concatenate([x.astype(np.int64) | np.int64(k) << 32 for x, k in zip(_read(t, "sigs", "<u4"), t.column("shard").to_pylist(), strict=True)])
        met = np.bincount(of, minlength=len(entry))
        left = (entry[:, 1] >> 2) - (entry[:, 2] - met)
        order = np.lexsort((sig, freq, of))
        of, sig = of[order], sig[order]
        rank = np.arange(len(of)) - np.repeat(np.cumsum(met) - met, met)
        keep = rank < left[of]
        return pa.table({"node": pa.array(entry[of[keep], 0]), "sig": pa.array(sig[keep])})

    ship(shared.sparkSession)
    return shared.groupBy("part").applyInArrow(run, "node long, sig long")


def candidates(docs: DataFrame, n: int, total: int) -> DataFrame:
    """(a, b): edges whose components hold every pair of different sets that may link. total: shingles of all sets, which sets the number of shards."""
    shards = max(1, -(-total // SHARD_SIGNATURES))
    spent = materialize(_spent(_shared(_index(docs, n, shards), shards)), "signatures")
    hubs = spent.groupBy("sig").agg(F.min("node").alias("b"), F.max("node").alias("top")).where("b < top").drop("top")
    hubs = materialize(hubs, "hubs")  # so that a frequent signature's rows can be split in the join
    return spent.join(hubs, "sig").where("node <> b").select(F.col("node").alias("a"), "b").distinct()


def _filter(nodes: DataFrame, count: int) -> tuple[np.ndarray, int]:
    """A Bloom filter with one bit a key, of bounded size: with more nodes than suit it more sets pass, none is lost."""
    bits = min(FILTER_BITS, 1 << max(10, (16 * count).bit_length()))
    page = min(bits, PAGE_BITS)

    def mark(t: pa.Table) -> pa.Table:
        on = np.zeros(page, np.uint8)
        on[t.column("off").to_numpy()] = 1
        return pa.table({"page": pa.array([t.column("page")[0].as_py()], pa.int32()), "on": pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())})

    ship(nodes.sparkSession)
    at = F.pmod(F.col("node"), F.lit(bits))
    placed = nodes.select(F.floor(at / page).cast("int").alias("page"), F.pmod(at, F.lit(page)).cast("int").alias("off")).distinct()
    out = np.zeros(bits // 64, np.int64)
    for r in placed.groupBy("page").applyInArrow(mark, "page int, on binary").collect():
        out[r["page"] * page // 64 : (r["page"] + 1) * page // 64] = np.frombuffer(bytes(r["on"]), np.int64)
    return out, bits


def verify(nodes: list[int], sets: list[np.ndarray], known: list[int] | None = None, only: list[bool] | None = None) -> list[tuple[int, int]]:
    """Links that connect whatever all the links among the sets connect; none between sets that are connected already. known: the component each set is known to be in; only: a pair counts if one of the two is marked."""
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), nodes[i]))
    size = np.array([len(sets[i]) for i in order])
    bits = max(256, 1 << int(size.max() - 1).bit_length())
    parity = np.zeros((len(order), bits // 64), np.uint64)
    for r, i in enumerate(order):
        odd = np.flatnonzero(np.bincount((sets[i] % np.uint64(bits)).astype(np.int64), minlength=bits) & 1)
        np.bitwise_or.at(parity[r], odd >> 6, np.uint64(1) << (odd & 63).astype(np.uint64))
    label = np.arange(len(order)) if known is None else np.unique(np.array(known)[order], return_inverse=True)[1]
    marked, out = None if only is None else np.array(only)[order], []
    for r in range(1, len(order)):
        lo = int(np.searchsorted(size[:r], (3 * size[r] + 3) // 4))
        open_ = label[lo:r] != label[r]
        if marked is not None and not marked[r]:
            open_ &= marked[lo:r]
        at = lo + np.flatnonzero(open_)
        # sets differ at least where the parities of their buckets do
        differ = np.bitwise_count(parity[at] ^ parity[r]).sum(1, dtype=np.int64)
        maybe = np.flatnonzero(7 * differ <= size[at] + size[r])
        for p in at[maybe[np.argsort(differ[maybe], kind="stable")]]:
            if label[p] == label[r]:
                continue
            common = len(np.intersect1d(sets[order[r]], sets[order[p]], assume_unique=True))
            if linked(common, int(size[r]), int(size[p])):
                out.append((nodes[order[r]], nodes[order[p]]))
                label[label == label[p]] = label[r]
    return out


def _met(dealt: DataFrame, by: list[str]) -> DataFrame:
    """(a, b): what verify() finds among the sets of each group. The rows are dealt by the group, however they lay before."""

    def meet(t: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
        known, only = (t.column(c).to_pylist() if c in t.column_names else None for c in ("known", "only"))
        got = verify(t.column("node").to_pylist(), sets, known, only)
        return pa.table({"a": pa.array([x for x, _ in got], pa.int64()), "b": pa.array([y for _, y in got], pa.int64())})

    ship(dealt.sparkSession)
    return dealt.repartition(*by).groupBy(*by).applyInArrow(meet, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, count: int, n: int) -> DataFrame:
    """(node, shingles) of the wanted nodes and, by chance of the filter, a few more."""
    held = docs.sparkSession.sparkContext.broadcast(_filter(wanted, count))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (words, bits), memo, seen = held.value, WordHash(), set()
        for b in slices(batches, 256):
            nodes, blobs = [], []
            for s in sets_of(b, memo, n):
                if len(s):
                    key = set_key(s)
                    at = key % bits
                    if words[at >> 6] >> (at & 63) & 1 and key not in seen:
                        if len(seen) < 200_000:
                            seen.add(key)
                        nodes.append(key)
                        blobs.append(s.tobytes())
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(blobs, pa.binary())], ["node", "shingles"])

    return map_arrow(docs.select("doc_id", "text"), run, "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))


def linked_nodes(docs: DataFrame, grouped: DataFrame, sizes: DataFrame, n: int) -> DataFrame:
    """(node, label): the components of the verified links in the candidate groups (node, label). sizes: (node, n_shingles) of all nodes.

    A group of at most BLOCK_SHINGLES is verified in one task. A larger one is dealt to blocks by node,
    each with the group's pivots, and verified block by block; after that only the sets outside its largest
    component meet the group again, in parts of PART_SHINGLES. So no group is ever gathered in one task, and
    a group of near copies costs about its size: only sets that neither pivots nor block mates connect cost
    the product of their number and the group's.
    """
    count = grouped.count()
    if not count:
        return grouped
    parts_of = lambda c, size: F.ceil(c / size).cast("int")
    sized = materialize(grouped.join(sizes, "node"), "sized")
    large = materialize(sized.groupBy("label").agg(parts_of(F.sum("n_shingles"), BLOCK_SHINGLES).alias("blocks")).where("blocks > 1"), "large")
    some = bool(large.limit(1).count())
    first = Window.partitionBy("label").orderBy(F.xxhash64("node"), "node")
    pivots = sized.join(large, "label").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= PIVOTS).select("node", F.lit(True).alias("pivot"))
    placed = sized.join(large, "label", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = (placed.join(pivots, "node", "left") if some else placed.withColumn("pivot", F.lit(None).cast("boolean"))).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    sets = materialize(_sets(docs, grouped, count, n).join(placed, "node"), "sets")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = sets.withColumn("block", F.explode(F.when(F.col("pivot"), every).otherwise(F.array("own"))))
    found = materialize(_met(dealt.select("label", "block", "node", "shingles"), ["label", "block"]), "links")
    known = components(found)
    if not some:
        return known
    known = materialize(known.withColumnRenamed("label", "known"), "known")
    parts = materialize(sets.where("blocks > 1").drop("shingles").join(known, "node", "left").withColumn("known", F.coalesce("known", "node")), "parts")
    sums = parts.groupBy("label", "known").agg(F.sum("n_shingles").alias("s")).groupBy("label").agg(F.max(F.struct("s", "known")).alias("most"), F.sum("s").alias("s"))
    sums = materialize(sums.select("label", F.col("most.known").alias("main"), parts_of(F.col("s"), PART_SHINGLES).alias("parts"), parts_of(F.col("s") - F.col("most.s"), PART_SHINGLES).alias("rests")).where("rests > 0"), "rests")
    own_of = lambda c, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(c)).cast("int")
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    base = parts.join(sums, "label").withColumn("only", F.col("known") != F.col("main"))
    members = base.select("label", "node", "known", F.lit(False).alias("only"), own_of("parts", 1).alias("part"), all_of("rests").alias("rest"))
    rest = base.where("only").select("label", "node", "known", "only", all_of("parts").alias("part"), own_of("rests", 2).alias("rest"))
    # a set of the rest that is also a member of the part is there once, marked
    again = members.unionByName(rest).groupBy("label", "part", "rest", "node", "known").agg(F.max("only").alias("only")).join(sets.select("node", "shingles"), "node")
    return components(found.unionByName(_met(again, ["label", "part", "rest"])))


def jaccard_groups(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id): the connected components under Jaccard of 0.75 or more on n-word shingle sets.

    Words are the text's ASCII-white-space-free chunks, A-Z lower-cased. Fewer than n words are one
    shingle; null, empty and blank texts have none and link with nothing. Equal sets are one node, so
    copies cost one set. component_id is the smallest doc_id of the component; rows that repeat a doc_id
    repeat, a null doc_id is never chosen while there is another. Other columns are ignored, whatever their
    names; no rows in, none out. Texts are read whole, however long. Shingles and sets are told apart by 64-bit hashes.
    """
    rows = materialize(digest(docs, n), "digests")
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    grouped = materialize(components(candidates(docs, n, total)), "candidates")
    sizes = rows.where("node IS NOT NULL").select("node", "n_shingles").distinct()
    labels = linked_nodes(docs, grouped, sizes, n)
    least = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = least.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    by_label = named.groupBy("label").agg(F.min("least").alias("component_id"))
    final = named.select("node", "label").join(by_label, "label").select("node", "component_id")
    out = rows.join(final, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))
