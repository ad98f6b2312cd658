"""Whole texts to token ids by way of their distinct chunks.

A text is cut at places no token can cross, every distinct chunk is encoded
once per worker, and a document's ids are the ids of its chunks in order.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np

from shoplens.llm.common import gather, offsets

_BEFORE_SPACE = re.compile(r" (?=\S)")
_OTHER_SPACE = re.compile(r" (?:\s|\Z)")


def cut_before_words(text: str) -> list[str]:
    """Cut before each space that a visible character follows.

    The split patterns of the byte-level vocabularies never match across such a
    place, whatever stands before it. The space belongs to the chunk after it
    and is left out of the key; the first chunk's key starts with a space
    instead, which no other key does.
    """
    parts = _BEFORE_SPACE.split(text) if _OTHER_SPACE.search(text) else text.split(" ")
    parts[0] = " " + parts[0]
    return parts


def text_of(key: str) -> str:
    """The chunk behind a key of cut_before_words."""
    return key[1:] if key.startswith(" ") else " " + key


def cut_at_blanks(text: str) -> list[str]:
    """Cut at spaces and line feeds, for vocabularies that drop white space."""
    return text.replace("\n", " ").split(" ")


class ChunkEncoder:
    """Ids of texts; `encode` maps a list of new chunks to (flat ids, lengths).

    Keeps the first `bound` chunks it meets, among which are the frequent ones;
    later ones are dropped after each call, so its memory does not grow with
    the corpus.
    """

    def __init__(self, cut: Callable, encode: Callable, bound: int = 500_000):
        self.cut, self.encode, self.bound = cut, encode, bound
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.starts = np.zeros(1 << 14, np.int64)
        self.lens = np.zeros(1 << 14, np.int64)

    def _add(self, chunks: list[str]) -> None:
        flat, lens = self.encode(chunks)
        n, first = len(chunks), len(self.index)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + n > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lens = np.concatenate([self.lens, np.zeros_like(self.lens)])
        self.flat[self.used:self.used + len(flat)] = flat
        at = offsets(lens)
        self.starts[first:first + n] = self.used + at[:-1]
        self.lens[first:first + n] = lens
        self.used += len(flat)
        self.index.update(zip(chunks, range(first, first + n)))

    def _trim(self) -> None:
        if len(self.index) > self.bound:
            for _ in range(len(self.index) - self.bound):
                self.index.popitem()  # the last one that came
            self.used = int(self.starts[self.bound])

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the place where each text's ids start (plus the end)."""
        cut = [self.cut(t) for t in texts]
        counts = offsets([len(c) for c in cut])
        every = list(chain.from_iterable(cut))
        at = np.fromiter(map(self.index.get, every, repeat(-1)), np.int64, len(every))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            self._add(list({every[i] for i in missing}))
            at[missing] = [self.index[every[i]] for i in missing]
        lens = self.lens[at]
        ids = gather(self.flat, self.starts[at], lens)
        per_chunk = offsets(lens)
        self._trim()
        return ids, per_chunk[counts]


def portions(texts: list[str], chars: int = 8_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters; one longer text is a range of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
