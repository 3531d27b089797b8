"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ids_of, map_arrow, materialize, mix, slices, table, texts_of

#: The fit takes about so many documents of each label, chosen by a hash of doc_id, and of those no more than so many bytes of features.
TRAIN_TOXIC, TRAIN_CLEAN, SAMPLE_BYTES = 5000, 8000, 160_000_000
#: A feature of fewer training documents is left out.
MIN_DOCS = 2


@dataclass(frozen=True)
class Settings:
    """FTRL: rate, smoothing, L1 of words and of pairs, L2, epochs, weight of a toxic document."""

    alpha: float = 1.0
    beta: float = 1.0
    l1_word: float = 8.0
    l1_pair: float = 36.0
    l2: float = 1.0
    epochs: int = 8
    toxic_weight: float = 1.0


#: The best of those tried by tune() on the training rows of sf0.1; GRID holds some that were not (see README).
SETTINGS = Settings()
GRID = [Settings(alpha=a, l1_word=w, l1_pair=p, toxic_weight=t) for a, w, p, t in product((0.5, 1.0, 2.0, 4.0), (0.5, 1.0, 2.0, 4.0, 8.0), (2.0, 6.0, 18.0, 36.0), (1.0, 3.0))]
#: A clean document of the sample stands for those left out, but for no more than so many.
MOST_WEIGHT = 3.0
#: One in so many training documents is kept back to set the cut, if at least LEAST_TOXIC of them are toxic.
FOLDS, LEAST_TOXIC = 5, 20
_PUNCT = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¡¿«»„“”‘’…–—"


class Features:
    """32-bit hashes of the words, the pairs of neighbours, and the pairs with one or two words between; the last two bits are the kind, in this order."""

    def __init__(self, limit: int = 150_000):
        self.memo: dict[bytes, int] = {}
        self.limit = limit

    def word(self, chunk: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(chunk.decode("utf-8").lower().strip(_PUNCT))
        if len(self.memo) < self.limit:
            self.memo[chunk] = h
        return h

    def of(self, text: bytes) -> np.ndarray:
        chunks, get, word = text.split(), self.memo.get, self.word
        w = np.fromiter((get(c) or word(c) for c in chunks), np.uint64, len(chunks))
        found = [mix(w)]
        for gap in (1, 2, 3):
            found.append(mix(w[:-gap] * np.uint64(0x9E3779B97F4A7C15) + w[gap:] + np.uint64(gap)))
        return np.concatenate([(h >> np.uint64(32)).astype(np.uint32) & np.uint32(0xFFFFFFFC) | np.uint32(kind) for kind, h in enumerate(found)])


class ToxicityModel:
    """Bias and the sparse weights, by sorted feature."""

    def __init__(self, bias: float, features: np.ndarray, weights: np.ndarray):
        self.bias, self.features, self.weights = bias, features, weights
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[features & 0xFFFFF] = True

    def score(self, features: np.ndarray) -> float:
        f = np.unique(features[self.maybe[features & 0xFFFFF]])
        z = self.bias
        if len(f) and len(self.features):
            at = np.minimum(np.searchsorted(self.features, f), len(self.features) - 1)
            z += float(self.weights[at][self.features[at] == f].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def ftrl(labels: np.ndarray, weight: np.ndarray, docs: list[np.ndarray], l1: np.ndarray, by: Settings = SETTINGS) -> np.ndarray:
    """Weights after the epochs' passes in the given order; docs hold places in l1, the L1 by feature; the bias comes last and has none."""
    dims = len(l1)
    z, n, l1 = np.zeros(dims + 1), np.zeros(dims + 1), np.append(l1, 0.0)

    def weights(i):
        return np.where(np.abs(z[i]) <= l1[i], 0.0, -(z[i] - np.sign(z[i]) * l1[i]) / ((by.beta + np.sqrt(n[i])) / by.alpha + by.l2))

    for _ in range(by.epochs):
        for y, s, doc in zip(labels, weight, docs, strict=True):
            i = np.append(doc, dims)
            w = weights(i)
            g = s * (1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y)
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / by.alpha * w
            n[i] += g * g
    return weights(np.arange(dims + 1))


def cut_of(z: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    """The logit from which calling documents toxic has the best F1 on a fold, in the middle of the gap below it; of equals the nearest to 0."""
    order = np.argsort(-z, kind="stable")
    z, toxic, weight = z[order], toxic[order], weight[order]
    caught, called = np.cumsum(toxic * weight), np.cumsum(weight)
    f1 = 2 * caught / (called + (toxic * weight).sum())
    f1[:-1][z[1:] == z[:-1]] = -1  # no cut lies between equals
    cuts = np.append((z[:-1] + z[1:]) / 2, z[-1] - 1)
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return float(cuts[best[np.argmin(np.abs(cuts[best]))]])


def average_precision(z: np.ndarray, toxic: np.ndarray) -> float:
    """The mean, over toxic documents, of the share of toxic ones among all with at least their logit."""
    levels, at = np.unique(-z, return_inverse=True)
    called = np.cumsum(np.bincount(at, minlength=len(levels)))
    caught = np.cumsum(np.bincount(at, toxic, len(levels)))
    return float((caught / called)[at][toxic > 0].mean())


class Training:
    """The rows of a sample, ordered by hashes of ids and features, their labels, weights and features by number."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        held = sorted((r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "toxic", "features")), strict=True)), key=lambda r: (xxhash.xxh32_intdigest(str(r[0])), r[0], r[2]))
        each = [np.frombuffer(r[2], np.uint32) for r in held]
        every, counts = np.unique(np.concatenate(each), return_counts=True) if each else (np.empty(0, np.uint32), np.empty(0, np.int64))
        self.features = every = every[counts >= MIN_DOCS]
        at = [np.minimum(np.searchsorted(every, x), max(0, len(every) - 1)) for x in each]
        self.docs = [i[every[i] == x] for i, x in zip(at, each, strict=True)] if len(every) else [np.empty(0, np.int64)] * len(each)
        self.toxic = np.array([float(r[1]) for r in held])
        self.fold = np.array([xxhash.xxh32_intdigest(str(r[0]), 1) % FOLDS for r in held], np.int64)

    def weights(self, by: Settings, clean_weight: float, took: np.ndarray | None = None) -> np.ndarray:
        """ftrl() of all rows, or those in `took`."""
        took = np.arange(len(self.docs)) if took is None else np.flatnonzero(took)
        weight = np.where(self.toxic > 0, by.toxic_weight, min(MOST_WEIGHT, clean_weight))
        return ftrl(self.toxic[took], weight[took], [self.docs[i] for i in took], np.where(self.features & 3, by.l1_pair, by.l1_word), by)

    def logits(self, w: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.array([w[self.docs[i]].sum() + w[-1] for i in np.flatnonzero(of)])


def sample_of(docs: DataFrame, labels: DataFrame, train_toxic: int = TRAIN_TOXIC, train_clean: int = TRAIN_CLEAN, sample_bytes: int = SAMPLE_BYTES) -> tuple[DataFrame, float]:
    """(doc_id, toxic, part, features) of a bounded sample of labelled documents, written, and how many clean documents one of them stands for, measured in toxic ones.

    About train_toxic and train_clean documents, and of either label at most its share of sample_bytes in features, both
    by the hash `part`; a document over that share by itself is left out. A document of several labels is toxic if one
    says so; null labels and ids are left out. Rows that repeat a doc_id are taken each."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    most = {True: train_toxic, False: train_clean}
    share = {t: min(1.0, rows / max(1, n.get(t, 0))) for t, rows in most.items()}
    picked = known.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003)
    picked = picked.where(F.col("part") < F.when(F.col("toxic"), share[True]).otherwise(share[False]))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most about train_toxic + train_clean ids

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in slices(batches, 256):
            found = [np.unique(features.of(t)).tobytes() for t in texts_of(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), b.column("part"), pa.array(found, pa.binary())], ["doc_id", "toxic", "part", "features"])

    sample = materialize(map_arrow(rows, featured, "doc_id long, toxic boolean, part double, features binary"), "toxicity")
    size, bound = F.octet_length("features"), F.when(F.col("toxic"), train_toxic).otherwise(train_clean) * (sample_bytes / (train_toxic + train_clean))
    sample = sample.where(size <= bound)
    upto = sample.select("toxic", "part", F.sum(size).over(Window.partitionBy("toxic").orderBy("part")).alias("upto"))
    over = {r["toxic"]: r["part"] for r in upto.where(F.col("upto") > bound).groupBy("toxic").agg(F.min("part").alias("part")).collect()}
    share |= {t: min(share[t], part) for t, part in over.items()}
    sample = sample.where(F.col("part") < F.when(F.col("toxic"), share[True]).otherwise(share[False]))
    return sample, max(1.0, share[True] / max(share[False], 1e-9))


def tune(docs: DataFrame, labels: DataFrame, grid: list[Settings] = GRID, at_once: int = 8) -> list[tuple[float, Settings]]:
    """Settings and their average precision over folds of the sample, the best first, of equals the first in the grid. The caller gives training rows only; each trial is a task of its own."""
    sample, clean_weight = sample_of(docs, labels)

    def trial(by: Settings) -> float:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, seen = Training(batches), []
            for fold in range(FOLDS):
                back = rows.fold == fold
                if rows.toxic[back].any() and rows.toxic[~back].any():
                    seen.append(average_precision(rows.logits(rows.weights(by, clean_weight, ~back), back), rows.toxic[back]))
            yield pa.RecordBatch.from_arrays([pa.array([float(np.mean(seen)) if seen else 0.0])], ["precision"])

        return map_arrow(sample.repartition(1), run, "precision double").first()["precision"]

    with ThreadPoolExecutor(at_once) as pool:
        return sorted(zip(pool.map(trial, grid), grid, strict=True), key=lambda r: -r[0])


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = SETTINGS, **bounds: int) -> ToxicityModel:
    """Fit on the bounded sample that sample_of() takes, weighted back to the share the labels have.

    Rows are trained on in an order that hashes of ids and features give. Without labelled documents, or documents,
    the model scores all texts below a half. The bias is moved so that a score of a half has the best F1 on a fold
    of the sample that a first fit leaves out.
    """
    sample, clean_weight = sample_of(docs, labels, **bounds)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, cut = Training(batches), 0.0
        if not rows.docs:
            return
        back = rows.fold == 0
        if rows.toxic[back].sum() >= LEAST_TOXIC and rows.toxic[~back].any():
            z = rows.logits(rows.weights(settings, clean_weight, ~back), back)
            cut = cut_of(z, rows.toxic[back], np.where(rows.toxic[back] > 0, 1.0, clean_weight))
        w = rows.weights(settings, clean_weight)
        w[-1] -= cut
        keep = np.flatnonzero(w[:-1])
        yield pa.RecordBatch.from_arrays([pa.array([float(w[-1])]), pa.array([rows.features[keep].tobytes()], pa.binary()), pa.array([w[:-1][keep].astype("<f8").tobytes()], pa.binary())], ["bias", "features", "weights"])

    got = map_arrow(sample.repartition(1), train, "bias double, features binary, weights binary").collect()  # one task, of a bounded number of bytes
    if not got:
        return ToxicityModel(-5.0, np.empty(0, np.uint32), np.empty(0))
    return ToxicityModel(got[0]["bias"], np.frombuffer(bytes(got[0]["features"]), np.uint32), np.frombuffer(bytes(got[0]["weights"])))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score): of each row's whole text, however long. Null and empty texts get the bias's score; repeated rows repeat, no rows in, none out; other columns are ignored, whatever their names."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids_of(b), pa.int64()), pa.array([held.value.score(features.of(t)) for t in texts_of(b)], pa.float64())], ["doc_id", "score"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, score double")


def held_out() -> Column:
    """Whether a row's labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


if __name__ == "__main__":
    import sys

    session = SparkSession.builder.appName("toxicity").getOrCreate()
    for precision, by in tune(table(session, sys.argv[1], "documents"), table(session, sys.argv[1], "labels").where(~held_out()))[:12]:
        print(f"{precision:.4f} {by}")
