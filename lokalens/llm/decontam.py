"""Benchmark decontamination: n-gram seeds lead from documents to test items, Smith-Waterman alignment scores what they share.

A seed is a run of words, or one with a word left open in it. Each item is searched for by its rarest
seeds, ranked by how many items share them, as many as reach over most of its words: what items have in
common leads to none of them, and no item is beyond search. What meets by chance is dropped before it is
aligned, by an upper bound of its score: the longest common subsequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import WordHash, ids_of, map_arrow, mix, slices, table, texts_of

#: Words of a seed; an item of fewer words is searched for as a whole.
SEED_WORDS = 3
#: An item's seeds are the rarest that together reach over this share of its words, and all that no more than RARE_ITEMS items share.
SEEDED, RARE_ITEMS = 2 / 3, 4
#: Alignment: a match, a mismatch, a gap; a test item counts as leaked from this share of the score it has with itself.
MATCH, MISMATCH, GAP, MIN_SCORE = 2, -1, -1, 0.5
#: Bytes of item texts sent to the executors at once; more items are searched in several passes.
BYTES_PER_PASS = 16_000_000
#: Items of more words are aligned without the bound, whose bit sets grow with the square of an item.
BOUND_WORDS = 1024
_PUNCT = bytes(c for c in range(33, 127) if not chr(c).isalnum())


class Words(WordHash):
    """Hashes of words without ASCII punctuation at their ends, in lower case."""

    def __missing__(self, chunk: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(chunk.decode("utf-8").lower().encode().strip(_PUNCT))
        if len(self) < self.limit:
            self[chunk] = h
        return h


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman of two word sequences: the best local score and the half-open span of text it covers; of equals the one that ends first."""
    if not len(item) or not len(text):
        return 0, 0, 0
    n = len(text)
    prev, came = np.zeros(n + 1, np.int64), np.arange(n + 1)
    steps = np.arange(n + 1) * GAP
    best = (0, 0, 0)
    for w in item:
        diag = prev[:-1] + np.where(text == w, MATCH, MISMATCH)
        up = prev[1:] + GAP
        score, at = np.zeros(n + 1, np.int64), np.arange(n + 1)
        take = diag >= up
        score[1:] = np.where(take, diag, up)
        at[1:] = np.where(take, came[:-1], came[1:])
        fresh = score <= 0
        score[fresh], at[fresh] = 0, np.flatnonzero(fresh)
        # a run of gaps from the left: the best of score[j] - steps[j] so far, carried to the right
        lead = score - steps
        far = np.maximum.accumulate(lead)
        origin = np.maximum.accumulate(np.where(lead == far, np.arange(n + 1), 0))
        run = far + steps
        longer = run > score
        score = np.where(longer, run, score)
        at = np.where(longer, at[origin], at)
        k = int(score.argmax())
        if score[k] > best[0]:
            best = (int(score[k]), int(at[k]), k)
        prev, came = score, at
    return best


def shared_words(item: list[int], text: list[int]) -> int:
    """The length of the longest common subsequence (bit-parallel): no alignment has more matches."""
    at: dict[int, int] = {}
    for i, w in enumerate(item):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    open_ = full
    for w in text:
        if w in at:
            met = open_ & at[w]
            open_ = (open_ + met | open_ - met) & full
    return len(item) - open_.bit_count()


def shapes_of(n: int, size: int) -> list[tuple[int, ...]]:
    """Where the words of a seed stand, for items of `size` words: n in a row, or n of n + 1 with one inside left open; all words of an item that has fewer."""
    n = min(n, size)
    return [tuple(range(n)), *(tuple(o for o in range(n + 1) if o != left) for left in range(1, n) if n < size)]


class Items:
    """The seeds of some test items, by sorted hash, and the items' words."""

    def __init__(self, ids: list[int | None], texts: list[bytes], seed_words: int):
        words = Words()
        blank = words[b""]
        self.ids, self.words = ids, [words.of(t.split()) for t in texts]
        # nothing but punctuation is no text
        placed = [(k, shape, self.hashes(w, shape)) for k, w in enumerate(self.words) if not (w == blank).all() for shape in shapes_of(seed_words, len(w))]
        self.shapes = sorted({shape for _, shape, _ in placed})
        own = [np.unique(h, return_index=True, return_inverse=True) for *_, h in placed]
        whole = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
        hashes, in_items = np.unique(whole([seeds for seeds, *_ in own], np.uint64), return_counts=True)
        shared = [in_items[np.searchsorted(hashes, seeds)] for seeds, *_ in own]
        level = [np.full(len(w), np.iinfo(np.int64).max) for w in self.words]
        for (k, shape, h), (*_, back), count in zip(placed, own, shared, strict=True):
            for o in shape:
                np.minimum(level[k][o : o + len(h)], count[back], out=level[k][o : o + len(h)])
        most = [max(RARE_ITEMS, int(np.sort(x)[int(np.ceil(SEEDED * len(x))) - 1])) if len(x) else 0 for x in level]
        seeds, item, low, high = [], [], [], []
        for (k, *_), (found, first, back), count in zip(placed, own, shared, strict=True):
            last = np.zeros(len(found), np.int64)
            np.maximum.at(last, back, np.arange(len(back)))
            rare = count <= most[k]
            seeds.append(found[rare])
            item.append(np.full(rare.sum(), k))
            low.append(first[rare])
            high.append(last[rare])
        every = whole(seeds, np.uint64)
        order = np.argsort(every, kind="stable")
        self.seeds = every[order]
        #: where in its item a seed stands first and last
        self.item, self.low, self.high = (whole(x, np.int64)[order] for x in (item, low, high))
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.seeds & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def hashes(self, w: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
        k = max(0, len(w) - shape[-1])
        out = np.full(k, sum(1 << min(o, 63) for o in shape) & (1 << 63) - 1, np.uint64)
        for o in shape:
            out = out * np.uint64(0x9E3779B97F4A7C15) + w[o : o + k]
        return mix(out)

    def candidates(self, w: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, from, to): the windows of a document to align, one for each cluster of an item's seeds on near diagonals."""
        found = []
        for shape in self.shapes:
            h = self.hashes(w, shape)
            at = np.flatnonzero(self.maybe[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
            if not len(at):
                continue
            # a seed that stands again and again is one run: its starts lie on near diagonals
            new = np.concatenate([[True], (h[at[1:]] != h[at[:-1]]) | (at[1:] != at[:-1] + 1)])
            run, until = at[new], at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
            lo, hi = np.searchsorted(self.seeds, h[run]), np.searchsorted(self.seeds, h[run], side="right")
            size = hi - lo
            s = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
            found.append((self.item[s], np.repeat(run, size) - self.high[s], np.repeat(until, size) - self.low[s]))
        if not found:
            return []
        item, begin, end = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((begin, item))
        out, now, first, last = [], -1, 0, 0

        def close() -> None:
            size = len(self.words[now])
            slack = size // 2 + 2
            out.append((now, max(0, first - slack), min(len(w), last + size + slack)))

        for k, b, e in zip(item[order].tolist(), begin[order].tolist(), end[order].tolist(), strict=True):
            if k == now and b - last <= len(self.words[k]):
                last = max(last, e)
                continue
            if now >= 0:
                close()
            now, first, last = k, b, e
        if now >= 0:
            close()
        return out


def leaks(docs: DataFrame, items: DataFrame, min_score: float = MIN_SCORE, seed_words: int = SEED_WORDS, bytes_per_pass: int = BYTES_PER_PASS) -> DataFrame:
    """(doc_id, item_id, score, start, end): the test items of which a document holds a copy, edited or not.

    Words are the text's ASCII-white-space-free chunks in lower case without ASCII punctuation at the
    ends. score is the best local alignment with the item over the item's own (1: a whole copy); start
    and end are the half-open span of words it covers. A document and an item meet once, with the best
    of their windows; of windows that score alike the first counts. They meet where they share one of the
    item's rarest seeds of seed_words words (see Items), and a whole item of fewer. How rare a seed is, is counted
    over the items of a pass, which are sent to the executors: bytes_per_pass of them at a time. Null and empty texts
    and items match nothing, nor do items without a word but punctuation; a null id stays null. Repeated rows give
    repeated results; long texts are searched whole; no documents or no items, no rows; other columns are ignored,
    whatever their names.
    """
    out = None
    for rows in item_passes(items, bytes_per_pass):
        part = _pass(docs, _held(docs, rows, seed_words), min_score)
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, min_score: float = MIN_SCORE, seed_words: int = SEED_WORDS, bytes_per_pass: int = BYTES_PER_PASS) -> DataFrame:
    """The rows of docs, all columns, that hold no copy of an item: those for which leaks() gives nothing. Rows are judged where they are, without a join."""
    rows_of = docs
    for rows in item_passes(items, bytes_per_pass):
        rows_of = _clean(rows_of, _held(docs, rows, seed_words), min_score)
    return rows_of


def _clean(docs: DataFrame, held, min_score: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, items = Words(), held.value
        for b in slices(batches):
            yield b.filter(pa.array([not _matches(items, words.of(t.split()), min_score) for t in texts_of(b)], pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def item_passes(items: DataFrame, bytes_per_pass: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items with text, (id, text), in lists of about bytes_per_pass; one empty list if there are none."""
    rows: list[tuple[int | None, bytes]] = []
    size = 0
    for r in items.where("text IS NOT NULL").select("item_id", "text").toLocalIterator():
        text = r["text"].encode()
        if rows and size + len(text) > bytes_per_pass:
            yield rows
            rows, size = [], 0
        rows.append((r["item_id"], text))
        size += len(text)
    yield rows


def _held(docs: DataFrame, rows: list[tuple[int | None, bytes]], seed_words: int):
    """A pass's items as a broadcast."""
    return docs.sparkSession.sparkContext.broadcast(Items([r[0] for r in rows], [r[1] for r in rows], seed_words))


def _matches(items: Items, w: np.ndarray, min_score: float) -> dict[int, tuple[float, int, int]]:
    """The best alignment of each item of which the document holds a copy, by the item's place."""
    best: dict[int, tuple[float, int, int]] = {}
    for k, lo, hi in items.candidates(w):
        size = len(items.words[k])
        if size <= BOUND_WORDS and MATCH * shared_words(items.words[k].tolist(), w[lo:hi].tolist()) / (MATCH * size) < min_score:
            continue
        s, begin, end = align(items.words[k], w[lo:hi])
        s /= MATCH * size
        if s >= min_score and (k not in best or s > best[k][0]):
            best[k] = (s, lo + begin, lo + end)
    return best


def _pass(docs: DataFrame, held, min_score: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, items = Words(), held.value
        for b in slices(batches):
            found = []
            for doc, t in zip(ids_of(b), texts_of(b), strict=True):
                w = words.of(t.split())
                found += [(doc, items.ids[k], *v) for k, v in sorted(_matches(items, w, min_score).items())]
            if found:
                columns = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[i], pa.float64() if i == 2 else pa.int64()) for i in range(5)], ["doc_id", "item_id", "score", "start", "end"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, item_id long, score double, start long, end long")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
