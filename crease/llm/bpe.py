"""Byte-pair merging by a heap over a linked list, and the caches in front of it."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from heapq import heapify, heappop, heappush
from pathlib import Path
from sys import getsizeof

#: Bytes of one cache. Texts repeat their words, so the first ones seen are mostly the frequent ones; a full cache
#: takes no more and later new words are worked out each time, with the same result.
CACHE_BYTES = 128 << 20
#: About what an entry needs beside its key and value.
ENTRY_BYTES = 110

#: The pre-tokenizer's pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: the vocabulary's special string and its id.
END_OF_TEXT, END_OF_TEXT_ID = "<|endoftext|>", 50256


def merge(symbols: list, rank: Callable[[object, object], float | None]) -> tuple[list, int]:
    """Merge adjacent symbols by lowest rank, leftmost first, until no pair has a rank.

    symbols: bytes or str pieces that concatenate with +. rank(left, right): None if the pair never merges. Returns
    the symbols by place, None where one went into its left neighbour, and the number of merges. O(n log n).
    """
    n = len(symbols)
    symbols = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [
        (r, i, symbols[i], symbols[i + 1])
        for i in range(n - 1)
        if (r := rank(symbols[i], symbols[i + 1])) is not None
    ]
    heapify(heap)
    merges = 0
    while heap:
        _, i, left, right = heappop(heap)
        if symbols[i] is not left or (j := after[i]) >= n or symbols[j] is not right:
            continue  # one side has changed since this entry was pushed
        pair = symbols[i] = left + right
        symbols[j] = None
        after[i] = k = after[j]
        merges += 1
        if k < n:
            before[k] = i
            if (r := rank(pair, symbols[k])) is not None:
                heappush(heap, (r, i, pair, symbols[k]))
        if (h := before[i]) >= 0 and (r := rank(symbols[h], pair)) is not None:
            heappush(heap, (r, h, symbols[h], pair))
    return symbols, merges


class Cache(dict):
    """value = make(key), kept for the first keys of short length until they fill `room` bytes."""

    def __init__(self, make: Callable[[str], object], room: int = CACHE_BYTES):
        self.make, self.room = make, room

    def __missing__(self, key: str):
        value = self.make(key)
        if self.room > 0 and len(key) <= 64:
            self[key] = value
            self.room -= getsizeof(key) + getsizeof(value) + ENTRY_BYTES
        return value


def byte_letters() -> dict[str, int]:
    """The bytes that the letters of a byte-level vocabulary stand for: printable ones for themselves, then the rest."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_byte_bpe(path: str) -> dict:
    """A byte-level BPE .json of the tokenizers library; refused if it is cut or normalised in another way than here."""
    spec = json.loads(Path(path).read_text())
    cut, model = spec["pre_tokenizer"] or {}, spec["model"]
    plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    special = [(t["content"], t["id"]) for t in spec["added_tokens"]]
    loose = any(t[f] for t in spec["added_tokens"] for f in ("single_word", "lstrip", "rstrip", "normalized"))
    odd = model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")
    if not plain or spec["normalizer"] or special != [(END_OF_TEXT, END_OF_TEXT_ID)] or loose or odd:
        raise ValueError(f"{path}: only a plain byte-level BPE with {END_OF_TEXT} as its one added token is counted")
    return spec


def load_merges(path: str) -> dict[tuple[bytes, bytes], int]:
    """The ranks of merged pairs in a byte-level BPE .json of the tokenizers library."""
    byte = byte_letters()
    pairs = (x.split(" ") if isinstance(x, str) else x for x in read_byte_bpe(path)["model"]["merges"])
    return {tuple(bytes(map(byte.__getitem__, x)) for x in pair): rank for rank, pair in enumerate(pairs)}


#: One-byte symbols, the same objects each time.
BYTES = [bytes([b]) for b in range(256)]


#: White space beside a space, or other white space than the usual: such texts are cut with more care.
ODD_SPACE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
LONE_SPACE = re.compile(r"(?<=\S)(?= \S)")


def chunks(text: str) -> tuple[list[str], list[str]]:
    """Cut a text at lone spaces, where no pre-token goes across: whole chunks at its start, then words.

    Each word stands for a chunk of one space and the word. A text with runs of white space gives whole chunks only.
    """
    if "  " in text or "\n " in text or " \n" in text or text[:1] == " " or text[-1:] == " " or ODD_SPACE.search(text):
        return [x for x in LONE_SPACE.split(text) if x], []
    words = text.split(" ")
    return ([words[0]] if words[0] else []), words[1:]


class ByteBpeCounter:
    """Counts the tokens of texts: bytes of each pre-token less the merges; no ids are made."""

    def __init__(self, path: str):
        import regex

        self.find = regex.compile(PATTERN).findall
        self.rank = load_merges(path)
        self.words = Cache(lambda word: self.chunk(" " + word))

    def pair(self, left: bytes, right: bytes) -> int | None:
        return self.rank.get((left, right))

    def chunk(self, text: str) -> int:
        n = 0
        for token in self.find(text):
            raw = token.encode()
            n += len(raw) - merge([BYTES[b] for b in raw], self.pair)[1]
        return n

    def count(self, text: str) -> int:
        """Tokens of a text; the special string is one token wherever it stands."""
        n = -1
        for part in text.split(END_OF_TEXT):
            whole, words = chunks(part)
            n += 1 + sum(map(self.chunk, whole)) + sum(map(self.words.__getitem__, words))
        return n
