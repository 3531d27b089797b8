"""Packing by power-of-two decomposition: a document is cut into pieces of binary length, and each piece is a sequence of its bucket; none crosses documents and none is padded."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .chunks import encoder_of
from .common import ids_of, map_arrow, slices, table, texts_of

#: Chunks that a Python worker remembers, at about 230 bytes each; it keeps them as long as it lives.
MEMO = 1_200_000
#: Bits of a sequence_id below its bucket (log2 of the length), and below the number of the task that made it.
BUCKET_BITS, TASK_BITS = 59, 33


def piece_lengths(n: int, longest: int) -> list[int]:
    """As many of the longest as go in, then the binary digits of the rest, large before small."""
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if n % longest >> k & 1]


def pack(docs: DataFrame, max_tokens: int = 4096, end_id: int = 2, tokenizer: str | None = None, with_ids: bool = False, memo: int = MEMO) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket[, ids]): one row per piece.

    max_tokens must be a power of two. A document's tokens are its whole text's ids and end_id; null or
    empty text is end_id alone. A piece of 2^k tokens is a whole sequence of bucket k, so offset is 0 and
    no token is padding. A row's pieces are its own even where rows repeat a doc_id; a null doc_id stays
    null. sequence_id is the bucket, the task and a count within the task: a task that runs again on the
    same split gives the same ids. Other columns are ignored, whatever their names; no rows in, none
    out. Long texts are encoded and cut whole, as others are. The tokenizer must drop white space.
    """
    if max_tokens < 1 or max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = encoder_of(path, memo), TaskContext.get().partitionId()
        made = [0] * max_tokens.bit_length()
        for b in slices(batches, 256):
            flat, begin = encoder.encode([t.split() for t in texts_of(b)])
            rows, pieces = [], []
            for doc, lo, hi in zip(ids_of(b), begin[:-1], begin[1:], strict=True):
                ids = np.append(flat[lo:hi], np.uint32(end_id)).astype("<u4")
                at = 0
                for length in piece_lengths(len(ids), max_tokens):
                    k = length.bit_length() - 1
                    piece = ids[at : at + length]
                    rows.append((doc, at, length, zlib.crc32(piece.tobytes()), len(ids), k << BUCKET_BITS | task << TASK_BITS | made[k], 0, k))
                    if with_ids:
                        pieces.append(piece.astype(np.int32))
                    made[k] += 1
                    at += length
            if rows:
                columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(pieces, pa.list_(pa.int32()))] if with_ids else []), names + ["ids"] * with_ids)

    return map_arrow(docs.select("doc_id", "text"), run, ", ".join(f"{n} long" for n in names) + ", ids array<int>" * with_ids)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
