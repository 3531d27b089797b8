"""Secrets in texts: three patterns, and strings whose symbols are as even as chance makes them.

Runs of 16 symbols or more are read in the smallest alphabet that holds them. A battery asks whether the
symbols could be drawn evenly and independently: chi-squared uniformity, runs above and below the
alphabet's middle, serial correlation. A run that passes may still be ordinary, as a short one proves
little. So its chi-squared statistic is also set against ordinary strings of its length, with the symbol
shares of the corpus's short runs that the alphabet holds, and of the runs of one alphabet and similar length as many
are reported as keep the share of false discoveries bounded (Benjamini and Hochberg).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ids_of, map_arrow, materialize, slices, table, texts_of

#: What the contract's kinds match, in lower case where either case counts, and how long they must be.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
CUES = (b"passw", b"secret", b"token", b"api")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")

#: Alphabets, the smallest first; a run belongs to the first that holds all of its symbols.
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = {
    "decimal": DIGITS, "hex": DIGITS + "abcdef", "HEX": DIGITS + "ABCDEF", "lower": LOWER, "upper": UPPER, "base32": UPPER + "234567",
    "lower36": LOWER + DIGITS, "upper36": UPPER + DIGITS, "letters": UPPER + LOWER, "alnum": UPPER + LOWER + DIGITS,
    "base64": UPPER + LOWER + DIGITS + "+/", "base64url": UPPER + LOWER + DIGITS + "-_", "other": UPPER + LOWER + DIGITS + "+/-_",
}
#: Symbols a candidate has at least; level of the battery's three tests together; false discoveries among what is reported of one alphabet and length.
LEAST, BATTERY_LEVEL, FALSE_SHARE = 16, 0.001, 0.01
#: Steps of p-values per power of ten, and the most.
STEPS, MOST_STEPS = 4, 160

_NAMES = list(ALPHABETS)
_SIZES = np.array([len(a) for a in ALPHABETS.values()])
_VALUE = np.full((len(_NAMES), 256), -1, np.int64)
for _i, _a in enumerate(ALPHABETS.values()):
    _VALUE[_i, np.frombuffer(_a.encode(), np.uint8)] = np.arange(len(_a))
#: For each byte the alphabets that lack it, as bits.
_LACKING = ((_VALUE < 0) << np.arange(len(_NAMES))[:, None]).sum(axis=0).astype(np.uint16)
_SYMBOL = _VALUE[-1] >= 0
_HEX = _VALUE[_NAMES.index("hex")] >= 0
_FIRST = np.array([next((i for i in range(len(_NAMES)) if not bits >> i & 1), -1) for bits in range(1 << len(_NAMES))], np.int8)


def runs_of(member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], member, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def alphabets_of(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The number of each run's alphabet; runs are disjoint, in order and not empty."""
    if not len(starts):
        return np.empty(0, np.int64)
    bounds = np.stack([starts, ends], axis=1).ravel()
    lacking = np.bitwise_or.reduceat(np.append(_LACKING[b], np.uint16(0)), bounds)[::2]
    return _FIRST[lacking].astype(np.int64)


# --- statistics -----------------------------------------------------------------------------------


def _upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _gamma_z(value: float, mean: float, variance: float) -> float:
    """The normal score of a non-negative statistic, as of a gamma variable of the same moments (Wilson and Hilferty's cube root)."""
    shape = mean * mean / variance
    return ((max(value, 0.0) / mean) ** (1 / 3) - (1 - 1 / (9 * shape))) * 3 * math.sqrt(shape)


def uniformity_p(values: np.ndarray, size: int) -> float:
    """Two-sided p-value of Pearson's statistic for symbols drawn evenly, by its exact moments."""
    n = len(values)
    counts = np.bincount(values, minlength=size)
    statistic = size / n * float((counts * counts).sum()) - n
    z = _gamma_z(statistic, size - 1, 2 * (size - 1) * (n - 1) / n)
    return min(1.0, 2 * min(_upper_tail(z), _upper_tail(-z)))


def runs_p(values: np.ndarray, size: int) -> float:
    """Two-sided p-value of the number of runs above and below the alphabet's middle (Wald and Wolfowitz)."""
    high = values >= size / 2
    n, a = len(values), int(high.sum())
    b = n - a
    if a == 0 or b == 0:
        return 2.0 ** (1 - n)
    mean = 2 * a * b / n + 1
    variance = (mean - 1) * (mean - 2) / (n - 1)
    if variance <= 0:
        return 1.0
    gap = abs(1 + int((high[1:] != high[:-1]).sum()) - mean)
    return min(1.0, 2 * _upper_tail(max(gap - 0.5, 0) / math.sqrt(variance)))


def serial_p(values: np.ndarray) -> float:
    """Two-sided p-value of the correlation of neighbours; 0 if all symbols are one."""
    n = len(values)
    off = values - values.mean()
    total = float(off @ off)
    if total == 0:
        return 0.0
    return min(1.0, 2 * _upper_tail(abs(float(off[1:] @ off[:-1]) / total + 1 / n) * math.sqrt(n)))


def battery_p(values: np.ndarray, size: int) -> float:
    """p-value of the three tests together (Bonferroni)."""
    return min(1.0, 3 * min(uniformity_p(values, size), runs_p(values, size), serial_p(values)))


def ordinary_p(values: np.ndarray, shares: np.ndarray) -> float:
    """The chance that as few pairs of equal symbols come up in a string of this length drawn by shares: small if it is more even than ordinary ones."""
    n = len(values)
    counts = np.bincount(values, minlength=len(shares))
    pairs = float((counts * (counts - 1)).sum())
    s2, s3 = float((shares**2).sum()), float((shares**3).sum())
    mean = n * (n - 1) * s2
    variance = n * (n - 1) * ((n - 2) * (n - 3) * s2 * s2 + 4 * (n - 2) * s3 + 2 * s2) - mean * mean
    return min(1.0, _upper_tail(-_gamma_z(pairs + 1, mean, max(variance, 1e-9))))


def length_class(n: int) -> int:
    """Two classes for each doubling of the length."""
    return int(2 * math.log2(n))


# --- passes ---------------------------------------------------------------------------------------


def ordinary_shares(docs: DataFrame) -> dict[str, np.ndarray]:
    """For each alphabet the shares of its symbols in the corpus's runs of fewer than LEAST symbols that it holds, each symbol counted once more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(_NAMES), 256), np.int64)
        for batch in batches:
            for raw in texts_of(batch):
                b = np.frombuffer(raw, np.uint8)
                starts, ends = runs_of(_SYMBOL[b])
                short = ends - starts < LEAST
                starts, ends = starts[short], ends[short]
                kind = alphabets_of(b, starts, ends)
                size = ends - starts
                at = np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(size) else np.empty(0, np.int64)
                total += np.bincount(np.repeat(kind, size) * 256 + b[at], minlength=total.size).reshape(total.shape)
        kind, symbol = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(symbol), pa.array(total[kind, symbol])], ["kind", "symbol", "n"])

    counts = np.zeros((len(_NAMES), 256))
    for r in map_arrow(docs.select("text"), run, "kind long, symbol long, n long").groupBy("kind", "symbol").agg(F.sum("n").alias("n")).collect():
        counts[r["kind"], r["symbol"]] += r["n"]
    out = {}
    for name, letters in ALPHABETS.items():
        held = [i for i, a in enumerate(ALPHABETS.values()) if set(a) <= set(letters)]
        own = counts[held].sum(axis=0)[np.frombuffer(letters.encode(), np.uint8)] + 1
        out[name] = own / own.sum()
    return out


def base_spans(raw: bytes, b: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of what the three patterns match, by start and kind."""
    found = []
    low = raw.lower()
    if any(cue in low for cue in CUES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(low) if len(m[2]) >= ASSIGN_LEAST]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= ACCESS_LEAST]
    starts, ends = runs_of(_HEX[b])
    long = ends - starts >= HEX_LEAST
    found += [(int(s), 2, int(e)) for s, e in zip(starts[long], ends[long], strict=True)]
    return sorted(found)


def candidates(b: np.ndarray, shares: dict[str, np.ndarray]) -> Iterator[tuple[int, int, str, int, float]]:
    """(start, end, alphabet, length class, p): the runs of LEAST symbols or more, with up to two = after them; p is 1 where the battery tells that symbols are not drawn evenly."""
    starts, ends = runs_of(_SYMBOL[b])
    long = ends - starts >= LEAST
    starts, ends = starts[long], ends[long]
    for start, end, kind in zip(starts.tolist(), ends.tolist(), alphabets_of(b, starts, ends).tolist(), strict=True):
        name, values = _NAMES[kind], _VALUE[kind][b[start:end]]
        p = ordinary_p(values, shares[name]) if battery_p(values, int(_SIZES[kind])) >= BATTERY_LEVEL else 1.0
        padding = b[end : end + 2].tobytes()
        yield start, end + len(padding) - len(padding.lstrip(b"=")), name, length_class(len(values)), p


def outside(runs: Iterator[tuple], spans: list[tuple[int, int, int]]) -> list[tuple]:
    """The runs that do not lie within one of the spans; both are sorted by start."""
    out, k, reach = [], 0, 0
    for run in runs:
        while k < len(spans) and spans[k][0] <= run[0]:
            reach = max(reach, spans[k][2])
            k += 1
        if run[1] > reach:
            out.append(run)
    return out


def _step(p: float) -> int:
    """The step of a p-value: it is at most 10^(-step / STEPS)."""
    return min(MOST_STEPS, int(-STEPS * math.log10(p))) if p > 0 else MOST_STEPS


def scanned(docs: DataFrame, shares: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, base, drawn): spans in code points of the patterns, and the candidates outside them with class and step of p."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            base, drawn = [], []
            for raw in texts_of(batch):
                b = np.frombuffer(raw, np.uint8)
                found = base_spans(raw, b)
                more = outside(candidates(b, shares), found)
                points = raw.isascii() or not (found or more)
                at = range(len(b) + 1) if points else np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])  # code points before each byte
                base.append([{"start": int(at[s]), "kind": k, "end": int(at[e])} for s, k, e in found])
                drawn.append([{"start": int(at[s]), "end": int(at[e]), "class": f"{name}/{size}", "step": _step(p)} for s, e, name, size, p in more])
            yield pa.RecordBatch.from_arrays([pa.array(ids_of(batch), pa.int64()), pa.array(base, pa.list_(_BASE)), pa.array(drawn, pa.list_(_DRAWN))], ["doc_id", "base", "drawn"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, base array<struct<start:long,kind:int,end:long>>, drawn array<struct<start:long,end:long,class:string,step:int>>")


_BASE = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_DRAWN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("class", pa.string()), ("step", pa.int32())])


def cuts(found: DataFrame) -> DataFrame:
    """(class, step): for each class of candidates the least step that is reported, if any is."""
    steps = found.select(F.explode("drawn").alias("d")).groupBy(F.col("d.class").alias("class"), F.col("d.step").alias("step")).agg(F.count("*").alias("n"))
    of = Window.partitionBy("class")
    ranked = steps.select("class", "step", F.sum("n").over(of).alias("all"), F.sum("n").over(of.orderBy(F.desc("step"))).alias("reported"))
    chance = F.pow(F.lit(10.0), -F.col("step") / STEPS)
    return ranked.where(chance * F.col("all") <= FALSE_SHARE * F.col("reported")).groupBy("class").agg(F.min("step").alias("step"))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) of each document.

    Spans are kind:start:end in code points, end exclusive, by start and then kind. Candidates within a pattern's span are no spans
    of their own. Null text is empty and has none; rows that repeat an id are scanned row by row and count each for what is
    ordinary; null ids stay; other columns are ignored, whatever their names; no rows in, none out."""
    found = materialize(scanned(docs, ordinary_shares(docs)), "scanned")
    at = {r["class"]: r["step"] for r in cuts(found).collect()}  # a row for each alphabet and length class
    least = F.create_map(*[F.lit(x) for kv in at.items() for x in kv]) if at else F.lit(None).cast("map<string,int>")
    drawn = F.filter("drawn", lambda d: F.coalesce(d["step"] >= least[d["class"]], F.lit(False)))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    random = F.transform(drawn, lambda d: F.struct(d["start"].alias("start"), F.lit(3).alias("kind"), d["end"].alias("end")))
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.size(drawn).cast("long").alias("n_random"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", random)).alias("spans"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets(table(spark, sf_dir, "documents"))
