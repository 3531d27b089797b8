"""Token counts by offset-mapped attribution: a document is encoded once, and each token goes to the section its characters lie in.

Rule for a token that crosses a boundary: it belongs to the section that holds most of its characters,
of equals to the earlier one; a token without characters in any section belongs to none (section -1).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .chunks import encoder_of, load
from .common import ids_of, map_arrow, slices, table, texts_of


#: Chunks that a Python worker remembers; characters of a section of the query.
MEMO, STRETCH = 500_000, 1000


def attribute(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray) -> np.ndarray:
    """The section of each token by the rule above. sections: (n, 2) sorted disjoint spans; token spans are half open."""
    out = np.full(len(starts), -1, np.int64)
    if not len(starts) or not len(sections):
        return out
    # the sections that a token may lie in: the first that ends behind its start to the last that starts before its end
    first = np.searchsorted(sections[:, 1], starts, side="right")
    stop = np.searchsorted(sections[:, 0], ends, side="left")
    one = np.flatnonzero(stop - first == 1)
    inside = np.minimum(ends[one], sections[first[one], 1]) > np.maximum(starts[one], sections[first[one], 0])
    out[one[inside]] = first[one[inside]]
    many = np.flatnonzero(stop - first > 1)
    if len(many):
        size = stop[many] - first[many]
        token = np.repeat(many, size)
        k = np.repeat(first[many] - np.cumsum(size) + size, size) + np.arange(size.sum())
        common = np.minimum(ends[token], sections[k, 1]) - np.maximum(starts[token], sections[k, 0])
        order = np.lexsort((k, -common, token))
        best = order[np.concatenate([[True], token[order][1:] != token[order][:-1]])]
        best = best[common[best] > 0]
        out[token[best]] = k[best]
    return out


def stretches(text: str, size: int = STRETCH) -> list[tuple[int, int]]:
    """Sections of `size` characters, the last one shorter; none of an empty text. Their bounds cut tokens."""
    return [(i, min(i + size, len(text))) for i in range(0, len(text), size)]


def line_sections(text: str) -> list[tuple[int, int]]:
    """The lines of a text, without their \\n, as half-open character spans."""
    out, at = [], 0
    for line in text.split("\n"):
        out.append((at, at + len(line)))
        at += len(line) + 1
    return out


def _chunk_starts(raw: bytes, text: str) -> np.ndarray:
    """Where the chunks of raw.split() start, in characters."""
    b = np.frombuffer(raw, np.uint8)
    white = (b == 32) | ((b >= 9) & (b <= 13))
    begin = np.flatnonzero(~white & np.concatenate([[True], white[:-1]])) if len(b) else np.empty(0, np.int64)
    if len(text) == len(raw):
        return begin
    return (np.cumsum((b & 0xC0) != 0x80) - 1)[begin]


def token_counts(docs: DataFrame, sections: Callable[[str], list[tuple[int, int]]] = line_sections, tokenizer: str | None = None, drops_white_space: bool = True) -> DataFrame:
    """(doc_id, section, start, end, n_tokens): every section of every document with the tokens that go to it.

    Spans are half open, in code points of the whole text; sections() returns them sorted and disjoint.
    Tokens that no section gets are counted under section -1 (start and end null), if there are any.
    Null text is read as empty: its one line is empty and has no tokens. Rows that repeat a doc_id are
    counted row by row; other columns are ignored, whatever their names; no rows in, none out. Long texts
    are encoded whole. Where the tokenizer keeps white space, set
    drops_white_space to False: texts are then encoded whole.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, whole = (encoder_of(path, MEMO, offsets=True), None) if drops_white_space else (None, load(path))
        for b in slices(batches, 256):
            columns: list[list[np.ndarray]] = [[] for _ in range(5)]
            lost: list[tuple] = []
            for doc, raw in zip(ids_of(b), texts_of(b), strict=True):
                text = raw.decode("utf-8")
                if encoder:
                    spans = encoder.offsets_of(raw.split(), _chunk_starts(raw, text))
                else:
                    spans = np.array(whole.encode(text, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
                cut = np.array(sections(text), np.int64).reshape(-1, 2)
                to = attribute(spans[:, 0], spans[:, 1], cut)
                n = np.bincount(to + 1, minlength=len(cut) + 1)
                for held, x in zip(columns, (np.array([doc] * len(cut), object), np.arange(len(cut)), cut[:, 0], cut[:, 1], n[1:]), strict=True):
                    held.append(x)
                if n[0]:
                    lost.append((doc, -1, None, None, int(n[0])))
            rows = [np.concatenate(c).tolist() + [x[i] for x in lost] for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], ["doc_id", "section", "start", "end", "n_tokens"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, section long, start long, end long, n_tokens long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of STRETCH characters of every document with its tokens."""
    return token_counts(table(spark, sf_dir, "documents"), stretches)
