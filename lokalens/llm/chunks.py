"""Encoding of whole texts by way of their white-space-free chunks.

word_bpe_49k drops white space and never merges across it, so a text's ids are those of its chunks in
turn; each distinct chunk is encoded once while a worker remembers it. That holds for any tokenizer
whose pre-tokenizer drops white space, and only for those: other files must be encoded whole.
"""

from __future__ import annotations

import os
import re
from itertools import chain, repeat

import numpy as np


def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: A line in lower case: Latin letters with ASCII marks after them, or anything else.
_LINE = re.compile(r"^(?:([a-zß-öø-ÿ]+)([.,;:!?%&*#$)\]}\"|-]*)|.*)$", re.M)
_encoders: dict[tuple[str, int, bool], ChunkEncoder] = {}


def encoder_of(path: str, limit: int, offsets: bool = False) -> ChunkEncoder:
    """The worker's own encoder: what one task has learned serves the next."""
    if (path, limit, offsets) not in _encoders:
        _encoders[path, limit, offsets] = ChunkEncoder(path, limit, offsets)
    return _encoders[path, limit, offsets]


class ChunkEncoder:
    """Remembers the ids of at most about `limit` chunks, in two generations: when the younger is full, the older goes and what was not used since with it.

    A chunk of Latin letters and some ASCII marks after them is two pre-tokens, so it is two entries:
    the letters in lower case, as the tokenizer reads them, learned once whatever follows them, and the
    marks. Letters are encoded many at a time with spaces between; each run's last id is one that ends a
    word. Any other chunk is one entry. A chunk's number is that of its first entry, shifted, and of its
    second; entry 0 is empty.
    """

    def __init__(self, path: str, limit: int, offsets: bool = False):
        self.tokenizer, self.half, self.offsets = load(path), max(1, limit // 2), offsets
        vocabulary = self.tokenizer.get_vocab()
        ends = [i for token, i in vocabulary.items() if token.endswith("</w>")]
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[ends] = True
        self.by_letters = bool(ends) and self._lowers()
        self.index: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}
        self.letters: dict[str, int] = {}
        self.n, self.used = 1, 0
        self.start, self.size, self.chars = (np.zeros(1024, np.int64) for _ in range(3))
        self.flat, self.spans = np.zeros(4096, np.uint32), np.zeros((4096, 2), np.int32)

    def _lowers(self) -> bool:
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        return ids("Thé ÀÖ Zz") == ids("thé àö zz")

    def _add(self, flat: np.ndarray, sizes: np.ndarray, chars: np.ndarray, spans: np.ndarray | None) -> int:
        """Room for entries with these ids, one after the other; the number of the first."""
        n, used = self.n + len(sizes), self.used + len(flat)
        if n > len(self.start):
            self.start, self.size, self.chars = (np.resize(x, max(n, 2 * len(x))) for x in (self.start, self.size, self.chars))
        if used > len(self.flat):
            self.flat = np.resize(self.flat, max(used, 2 * len(self.flat)))
            if self.offsets:
                self.spans = np.resize(self.spans, (len(self.flat), 2))
        first = self.n
        self.size[first:n], self.chars[first:n] = sizes, chars
        self.start[first:n] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : used] = flat
        if self.offsets and len(flat):
            self.spans[self.used : used] = spans
        self.n, self.used = n, used
        return first

    def _learn_letters(self, new: list[str]) -> None:
        if not self.offsets:  # ASCII letters are read as they are, so the model alone gives their ids
            model = self.tokenizer.model
            plain = [t for t in new if t.isascii()]
            ids = [[x.id for x in model.tokenize(t)] for t in plain]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            first = self._add(np.fromiter(chain.from_iterable(ids), np.uint32, sizes.sum()), sizes, np.zeros(len(ids), np.int64), None)
            self.letters.update(zip(plain, range(first, first + len(plain)), strict=True))
            new = [t for t in new if not t.isascii()]
        for k in range(0, len(new), 2000):
            part = new[k : k + 2000]
            got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(got.ids, np.uint32)
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) != len(part):
                raise ValueError("the tokenizer does not end each word with one id")
            sizes, length = np.diff(stop, prepend=0), np.fromiter(map(len, part), np.int64, len(part))
            spans = np.array(got.offsets, np.int64).reshape(-1, 2) - np.repeat(np.cumsum(length + 1) - length - 1, sizes)[:, None] if self.offsets else None
            first = self._add(ids, sizes, length, spans)
            self.letters.update(zip(part, range(first, first + len(part)), strict=True))

    def _learn_others(self, new: list[bytes]) -> None:
        if not new:
            return
        texts = [c.decode("utf-8") for c in new]
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        ids = [e.ids for e in found]
        spans = np.array([o for e in found for o in e.offsets], np.int64).reshape(-1, 2) if self.offsets else None
        first = self._add(np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)), np.fromiter(map(len, texts), np.int64, len(texts)), spans)
        self.index.update(zip(new, range(first << 32, first + len(new) << 32, 1 << 32), strict=True))

    def _age(self) -> None:
        """The younger generation becomes the older one; entries that only the older had go."""
        values = np.fromiter(self.index.values(), np.int64, len(self.index))
        kept = np.unique(np.concatenate([[0], values >> 32, values & 0xFFFFFFFF]))
        to = np.zeros(self.n, np.int64)
        to[kept] = np.arange(len(kept))
        size = self.size[kept]
        at = np.repeat(self.start[kept] - np.cumsum(size) + size, size) + np.arange(size.sum())
        self.flat = self.flat[at]
        self.spans = self.spans[at] if self.offsets else self.spans
        self.start, self.size, self.chars = np.cumsum(size) - size, size, self.chars[kept]
        self.n, self.used = len(kept), len(at)
        self.letters = {t: k for t, a in self.letters.items() if (k := int(to[a]))}
        self.old = dict(zip(self.index, (to[values >> 32] << 32 | to[values & 0xFFFFFFFF]).tolist(), strict=True))
        self.index = {}

    def _learn(self, chunks: set[bytes]) -> None:
        old, letters = self.old, self.letters
        again = [c for c in chunks if c in old]
        self.index.update(zip(again, map(old.__getitem__, again), strict=True))
        new = [c for c in chunks if c not in old]
        if not self.by_letters or not new:
            self._learn_others(new)
            return
        stems, marks = zip(*_LINE.findall(b"\n".join(new).decode("utf-8").lower()), strict=True)
        self._learn_letters([t for t in set(stems) if t and t not in letters])
        tails = {m: m.encode() for m in set(marks) if m}
        self._learn_others([c for c, t in zip(new, stems, strict=True) if not t] + [m for m in tails.values() if m not in self.index and m not in old])
        tail = {m: (self.index.get(c) or old[c]) >> 32 for m, c in tails.items()} | {"": 0}
        values = np.fromiter(map(letters.get, stems, repeat(0)), np.int64, len(new)) << 32 | np.fromiter(map(tail.__getitem__, marks), np.int64, len(new))
        plain = np.flatnonzero(values >> 32)
        self.index.update(zip([new[i] for i in plain.tolist()] if len(plain) < len(new) else new, values[plain].tolist(), strict=True))

    def numbers(self, chunks: list[bytes]) -> np.ndarray:
        if len(self.index) > self.half:
            self._age()
        k = np.fromiter(map(self.index.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(k < 0)
        if len(missing):
            new = [chunks[i] for i in missing.tolist()]
            self._learn(set(new))
            k[missing] = np.fromiter(map(self.index.__getitem__, new), np.int64, len(new))
        return k

    def _places(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The chunks' entries, two each, their sizes, and where in `flat` their tokens are."""
        k = self.numbers(chunks)
        entry = np.empty(2 * len(k), np.int64)
        entry[::2], entry[1::2] = k >> 32, k & 0xFFFFFFFF
        size = self.size[entry]
        at = np.repeat(self.start[entry] - np.cumsum(size) + size, size)
        at += np.arange(len(at))
        return entry, size, at

    def encode(self, split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts' chunks, one text after the other, and where each text's begin and, at last, end."""
        _, size, at = self._places(list(chain.from_iterable(split)))
        begin = np.concatenate([[0], np.cumsum(size)])[2 * np.concatenate([[0], np.cumsum([len(c) for c in split])]).astype(np.int64)]
        return self.flat[at], begin

    def offsets_of(self, chunks: list[bytes], starts: np.ndarray) -> np.ndarray:
        """The half-open character spans of the chunks' tokens, where the chunks start at `starts`."""
        entry, size, at = self._places(chunks)
        shift = np.repeat(starts, 2)
        shift[1::2] += self.chars[entry[::2]]
        return self.spans[at] + np.repeat(shift, size)[:, None]
