"""Language ID by words first: log frequency of known words by language, and for unseen words the longest known character n-grams."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, materialize, slices, table, texts_of

#: Bounds of the fit: labelled documents of a language (chosen by a hash of doc_id), and entries kept by count.
TRAIN_DOCS, KEEP_WORDS, KEEP_GRAMS = 3000, 40_000, 20_000
LONGEST = 5
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def grams_of(word: str, n: int) -> list[str]:
    framed = f"\x02{word}\x03" if n > 1 else word
    return [framed[i : i + n] for i in range(len(framed) - n + 1)]


def _counts(sample: DataFrame) -> DataFrame:
    """(n, gram, lang, c): n 0 for whole words; summed within each task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for b in slices(batches):
            for lang, text in zip(b.column("lang").to_pylist(), texts_of(b), strict=True):
                words.setdefault(lang, Counter()).update(_LETTERS.findall(text.decode("utf-8").lower()))
        for lang, found in words.items():
            for n in range(LONGEST + 1):
                c = found if n == 0 else Counter()
                if n:
                    for w, k in found.items():
                        for g in grams_of(w, n):
                            c[g] += k
                rows = list(c.items())
                for i in range(0, len(rows), 50_000):
                    part = rows[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([n] * len(part), pa.int32()), pa.array([x[0] for x in part], pa.string()), pa.array([lang] * len(part), pa.string()), pa.array([x[1] for x in part], pa.int64())], ["n", "gram", "lang", "c"])

    return map_arrow(sample.select("lang", "text"), run, "n int, gram string, lang string, c long").groupBy("n", "gram", "lang").agg(F.sum("c").alias("c"))


class LanguageModel:
    """Log frequencies by language of the kept words and n-grams; its size is bounded by the bounds of the fit."""

    def __init__(self, tables: list[pa.Table], totals: dict[int, dict[str, int]]):
        """tables: (n, gram, counts), counts by language in order. They stay Arrow, as the driver would hold a row of Python objects for each entry otherwise."""
        self.langs = sorted(totals.get(0, {}))
        size = Counter(n for t in tables for n in t.column("n").to_numpy().tolist())
        whole = {n: [c.get(x, 0) + 0.5 * size[n] for x in self.langs] for n, c in totals.items()}
        self.place: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        self.logs = np.zeros((sum(size.values()) + 1, len(self.langs)))  # the last row, of zeros, is for a word of which nothing is known
        i = 0
        for b in (b for t in tables for b in t.to_batches(max_chunksize=1024)):
            for n, gram, c in zip(*(b.column(x).to_pylist() for x in ("n", "gram", "counts")), strict=True):
                self.place[n][gram] = i
                self.logs[i] = [math.log((x + 0.5) / y) for x, y in zip(c, whole[n], strict=True)]
                i += 1

    def places(self, word: str) -> list[int]:
        """The word's own row if it is known, else at each position that of the longest known n-gram."""
        if (i := self.place[0].get(word)) is not None:
            return [i]
        found, framed, place = [], f"\x02{word}\x03", self.place
        for i in range(len(framed) - 1):
            for n in range(min(LONGEST, len(framed) - i), 0, -1):
                k = place[n].get(framed[i : i + n])
                if k is not None:
                    found.append(k)
                    break
        return found or [len(self.logs) - 1]

    def of_words(self, words: list[str]) -> np.ndarray:
        """A row for each word: the mean of its places' rows."""
        each = [self.places(w) for w in words]
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        flat = np.fromiter((i for x in each for i in x), np.int64, int(sizes.sum()))
        return np.add.reduceat(self.logs[flat], np.cumsum(sizes) - sizes) / sizes[:, None]


class Scorer:
    """Remembers what white-space-free chunks add; forgets all of it beyond `limit` chunks."""

    def __init__(self, model: LanguageModel, limit: int = 120_000):
        self.model, self.limit = model, limit
        self.width = len(model.langs) + 2  # beside the languages, the words and those known as words
        self._reset()

    def _reset(self) -> None:
        self.index: dict[bytes, int] = {}
        self.rows = np.zeros((1024, self.width))

    def learn(self, chunks: set[bytes]) -> None:
        if len(self.index) > self.limit:
            self._reset()
        new = [c for c in chunks if c not in self.index]
        n = len(self.index)
        if n + len(new) > len(self.rows):
            self.rows = np.resize(self.rows, (max(n + len(new), 2 * len(self.rows)), self.width))
        each = [_LETTERS.findall(c.decode("utf-8").lower()) for c in new]
        words = list({w for x in each for w in x})
        self.rows[n : n + len(new)] = 0.0
        if words:
            place = dict(zip(words, range(len(words)), strict=True))
            value = np.column_stack([self.model.of_words(words), np.ones(len(words)), [w in self.model.place[0] for w in words]])
            sizes = np.fromiter(map(len, each), np.int64, len(each))
            flat = np.fromiter((place[w] for x in each for w in x), np.int64, int(sizes.sum()))
            some = np.flatnonzero(sizes)
            self.rows[n + some] = np.add.reduceat(value[flat], (np.cumsum(sizes) - sizes)[some])
        self.index.update(zip(new, range(n, n + len(new)), strict=True))

    def score(self, chunks: list[bytes]) -> tuple[str, float]:
        return self.judge(chunks)[:2]

    def judge(self, chunks: list[bytes]) -> tuple[str, float, int, int]:
        """The best language and its score, the number of words and of those known as words."""
        k = np.fromiter(map(self.index.__getitem__, chunks), np.int64, len(chunks))
        total = self.rows[k].sum(0)
        words, known = int(total[-2]), int(total[-1])
        if not words or self.width == 2:
            return "und", 0.0, words, known
        p = np.exp(total[:-2] - total[:-2].max())
        best = int(p.argmax())
        return self.model.langs[best], float(p[best] / p.sum()), words, known


def fit(train: DataFrame, train_docs: int = TRAIN_DOCS, keep_words: int = KEEP_WORDS, keep_grams: int = KEEP_GRAMS) -> LanguageModel:
    """Fit on about train_docs documents of each non-null lang. Rows with null text add nothing; an empty table gives a model without languages."""
    known = train.where("lang IS NOT NULL AND text IS NOT NULL")
    share = {r["lang"]: min(1.0, train_docs / r["n"]) for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return LanguageModel([], {})
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    pick = F.create_map(*[F.lit(x) for kv in share.items() for x in kv])
    counts = materialize(_counts(known.where(part < pick[F.col("lang")])), "language-counts")
    by_gram = counts.groupBy("n", "gram").agg(F.sum("c").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "c"))).alias("by"))
    totals: dict[int, dict[str, int]] = {}
    for r in counts.groupBy("n", "lang").agg(F.sum("c").alias("c")).collect():
        totals.setdefault(r["n"], {})[r["lang"]] = r["c"]
    if not totals.get(0):
        return LanguageModel([], {})
    of_lang = F.transform(F.array(*[F.lit(x) for x in sorted(totals[0])]), lambda x: F.coalesce(F.col("by")[x], F.lit(0)))
    tables = []
    for words in (True, False):
        kept = by_gram.where(F.col("n") == 0).where("all >= 2").orderBy(F.desc("all"), "gram").limit(keep_words) if words else by_gram.where(F.col("n") > 0).orderBy(F.desc("all"), "n", "gram").limit(keep_grams * LONGEST)
        tables.append(kept.select("n", "gram", of_lang.alias("counts")).toArrow())
    return LanguageModel(tables, totals)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score, text...): all columns of docs and the prediction of each whole text.

    'und' with score 0 where the text is null, empty or without a letter, or where no language was
    learned; equal scores go to the language first in order. Columns of docs named lang_pred or score
    are replaced. Rows repeat as they do in docs.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    keep = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for b in slices(batches, 512):
            split = [t.split() for t in texts_of(b)]
            scorer.learn({c for chunks in split for c in chunks})
            got = [scorer.score(chunks) for chunks in split]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], [*names, "lang_pred", "score"])

    schema = docs.select(*names).schema.add("lang_pred", "string").add("score", "double")
    return map_arrow(docs.select(*names), run, schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    model = fit(docs.where(~held_out))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def reject_undetermined(docs: DataFrame, model: LanguageModel, min_score: float, min_known: float = 0.0, few_words: int = 0) -> DataFrame:
    """The rows of docs whose language is determined with at least min_score and of whose words, where there are few_words or more, at least the share min_known is known; the columns stay as they are."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for b in slices(batches, 512):
            split = [t.split() for t in texts_of(b)]
            scorer.learn({c for chunks in split for c in chunks})
            got = [scorer.judge(chunks) for chunks in split]
            yield b.filter(pa.array([lang != "und" and p >= min_score and (words < few_words or known >= min_known * words) for lang, p, words, known in got], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
