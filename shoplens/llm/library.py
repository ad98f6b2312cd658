"""Ids of the tokenizers library for whole texts.

Most texts are encoded by ranks: the vocabulary's merges are turned into a
table of byte strings and their ranks, which tiktoken applies several times
faster. That gives the same ids if every token's own bytes replay to the merge
that makes it, which is checked when a vocabulary is loaded.

All other texts (other vocabularies, words of thousands of characters, rare
letters where case or normal form matter) go through the library itself, each
distinct piece once: its own model encodes every piece, and its own normalizer
and split are used for every chunk with characters beyond ASCII. For ASCII
chunks the split is stated here as a plain pattern, which is the same.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np

from shoplens.llm.chunks import ChunkEncoder, cut_at_blanks, cut_before_words, text_of
from shoplens.llm.common import gather, offsets, worker_cache

# The ASCII part of the two vocabularies' split patterns.
_BYTE_LEVEL = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
_WORD_LEVEL = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z]+|[0-9]|[^\sA-Za-z0-9]+", re.ASCII)

# The byte-level split pattern, and the letters, digits and white space up to U+017F
# (in lower case, without U+0130, whose lower case has two characters).
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BEYOND = re.compile("[^\x00-\u012f\u0131-\u017f]")
_LETTER, _DIGIT, _WHITE = "a-zªµºß-öø-ÿĀ-ſ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^{_WHITE}{_LETTER}{_DIGIT}]+")
_TWO_WHITE = re.compile(r"\s\s")
_BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")


def _byte_letters() -> dict[int, str]:
    """The visible letter that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Pieces:
    """Pieces of chunks and their ids, for one vocabulary file."""

    def __init__(self, path: str, word_ends: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.normal = self.tokenizer.normalizer
        self.word_ends = word_ends
        self.letters = _byte_letters()

    def of(self, key: str) -> list[str]:
        if self.word_ends:
            if not key:
                return []
            if not key.isascii():
                return [p for p, _ in self.split(self.normal.normalize_str(key))]
            key = key.lower()
            if key.isalpha():
                return [key]
            pieces = _WORD_LEVEL.findall(key)
        else:
            if key.isascii() and key.isalpha():
                return ["Ġ" + key]  # the letter of the space
            text = text_of(key)
            if not text.isascii():
                return [p for p, _ in self.split(text)]
            pieces = _BYTE_LEVEL.findall(text)
        return [p.replace(" ", "Ġ") if p.isprintable() else p.translate(self.letters)
                for p in pieces]

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cut = [self.of(c) for c in chunks]
        distinct = list(set().union(*cut))
        place = dict(zip(distinct, range(len(distinct))))
        ids = [[t.id for t in self.model.tokenize(p)] for p in distinct]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(lens.sum()))
        at = np.fromiter(map(place.__getitem__, chain.from_iterable(cut)), np.int64)
        per_piece = offsets(lens[at])
        return (gather(flat, offsets(lens)[:-1][at], lens[at]),
                np.diff(per_piece[offsets([len(x) for x in cut])]))


def rank_table(path: str, word_ends: bool) -> dict[bytes, int] | None:
    """The vocabulary as byte strings and ranks, or None where ranks would not give the same ids.

    The mark of a word's end becomes a space after the word. Ranks join the
    pair whose joined bytes rank lowest, merges the pair that is listed first.
    Both do the same if tokens rank as their merges are listed and the bytes of
    every token, joined by lower ranks alone, end at the pair of its merge.
    """
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    model, special = parts["model"], {x["content"] for x in parts["added_tokens"]}
    back = {letter: byte for byte, letter in _byte_letters().items()}
    suffix = model.get("end_of_word_suffix") or ""
    if model["type"] != "BPE" or model.get("ignore_merges") or bool(suffix) != word_ends:
        return None

    def raw(token: str) -> bytes:
        ends = bool(suffix) and token.endswith(suffix) and token != suffix
        return bytes(back[c] for c in (token[:-len(suffix)] if ends else token)) + b" " * ends

    ranks = {raw(token): i for token, i in model["vocab"].items() if token not in special}
    if len(ranks) != len(model["vocab"].keys() - special):
        return None
    last = max(i for token, i in ranks.items() if len(token) == 1 or word_ends and token[1:] == b" ")
    for merge in model["merges"]:
        left, right = map(raw, merge.split(" ") if isinstance(merge, str) else merge)
        rank = ranks.get(left + right, -1)
        if rank <= last or _last_pair(left + right, ranks) != [left, right]:
            return None
        last = rank
    return ranks


def _last_pair(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The two parts that the bytes of a token come down to before its own rank joins them."""
    parts = [token[i:i + 1] for i in range(len(token))]
    if token[1:].endswith(b" "):  # the space is no byte of its own: it marks the end
        parts[-2:] = [parts[-2] + b" "]
    while len(parts) > 2:
        found = [ranks.get(a + b, 1 << 40) for a, b in zip(parts, parts[1:])]
        i = found.index(min(found))
        if found[i] == 1 << 40:
            break
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return parts


class RankEncoder:
    """Ids of texts by ranks, with `other` for the texts that ranks are not used for."""

    def __init__(self, ranks: dict[bytes, int], word_ends: bool, other: ChunkEncoder):
        import tiktoken

        def table(pattern: str) -> tiktoken.Encoding:
            return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

        self.other, self.word_ends = other, word_ends
        if word_ends:
            self.words = table("[^ ]+ ")
        else:
            # Without two white spaces in a row looking ahead makes no difference, and costs much.
            self.single, self.plain = table(_SPLIT.replace(r"|\s+(?!\S)", "")), table(_SPLIT)

    def _by_ranks(self, text: str) -> bool:
        """Long words are left to `other`: joining by ranks takes the square of their length."""
        return not (self.word_ends and _BEYOND.search(text)) and all(
            text.find(" ", i, i + 1000) >= 0 for i in range(0, len(text) - 999, 1000))

    def _ids(self, text: str) -> list[int]:
        if not self.word_ends:
            return (self.plain if _TWO_WHITE.search(text) else self.single).encode_ordinary(text)
        words = _WORD.findall(text.lower())
        return self.words.encode_ordinary(" ".join(words) + " ") if words else []

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the place where each text's ids start (plus the end)."""
        found: list = [None] * len(texts)
        rest = []
        for i, text in enumerate(texts):
            if self._by_ranks(text):
                found[i] = ids = array("i")
                for part in _slices(text):
                    ids.extend(self._ids(part))
            else:
                rest.append(i)
        if rest:
            flat, at = self.other.encode_texts([texts[i] for i in rest])
            for i, a, b in zip(rest, at[:-1].tolist(), at[1:].tolist()):
                found[i] = flat[a:b]
        return np.frombuffer(b"".join(found), np.int32), offsets([len(x) for x in found])


def _slices(text: str, size: int = 1 << 20) -> Iterator[str]:
    """A text in slices, cut before a space between two words, which no token crosses."""
    start = 0
    while len(text) - start > size and (cut := _BETWEEN_WORDS.search(text, start + size)):
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def encoder(path: str, word_ends: bool = False, bound: int = 500_000) -> RankEncoder | ChunkEncoder:
    """This worker's encoder for a vocabulary file.

    `word_ends`: the vocabulary drops white space and marks ends of words;
    otherwise it is byte-level and keeps every byte.
    """
    cache = worker_cache("library")
    key = ("library", path, word_ends, bound)
    if key not in cache:
        pieces = _Pieces(path, word_ends)
        other = ChunkEncoder(cut_at_blanks if word_ends else cut_before_words, pieces.encode, bound)
        ranks = rank_table(path, word_ends)
        cache[key] = RankEncoder(ranks, word_ends, other) if ranks else other
    return cache[key]
