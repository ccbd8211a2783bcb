"""Byte-level BPE over whole texts, with the byte length of every token.

A text falls into chunks (a white-space run less its last character, or one
white-space character and the run of other characters after it) across whose
borders no token of the split pattern can reach.  Each distinct chunk is
encoded once and remembered, so a text costs one regex scan and one dictionary
probe per chunk.
"""

from __future__ import annotations

import base64
import re
from array import array

import numpy as np

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNK = re.compile(f"[{_WHITE}]+(?=[{_WHITE}][^{_WHITE}])|[{_WHITE}]+\\Z|[{_WHITE}]?[^{_WHITE}]+")
REMEMBERED = 400_000


class Chunks(dict):
    """Chunk -> its number; CSR arrays hold the ids and byte lengths of its tokens."""

    def __init__(self, path: str = TOKENIZER) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size_of = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.size_of[rank] = len(token)
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.ids, self.first = array("i"), array("q", [0])

    def __missing__(self, chunk: str) -> int:
        self.ids.extend(self.encoding.encode_ordinary(chunk))
        self.first.append(len(self.ids))
        n = self[chunk] = len(self.first) - 2
        return n

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all texts, bounds of each text in them)."""
        if len(self) > REMEMBERED:
            self.forget()
        get = self.__getitem__
        each = [list(map(get, CHUNK.findall(t))) if t else [] for t in texts]
        size = np.fromiter(map(len, each), np.int64, len(each))
        k = np.fromiter((x for e in each for x in e), np.int64, int(size.sum()))
        first = np.array(self.first, np.int64)
        n = (first[1:] - first[:-1])[k]
        total = np.append(0, np.cumsum(n))
        at = np.arange(int(total[-1])) - np.repeat(total[:-1], n) + np.repeat(first[k], n)
        ids = np.array(self.ids, np.int32)[at] if len(at) else np.zeros(0, np.int32)
        return ids, total[np.append(0, np.cumsum(size))]

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Number of tokens of every text."""
        if len(self) > REMEMBERED:
            self.forget()
        get, out = self.__getitem__, []
        for t in texts:
            k = np.fromiter(map(get, CHUNK.findall(t)), np.int64) if t else np.zeros(0, np.int64)
            first = np.frombuffer(self.first, np.int64)
            out.append(int((first[k + 1] - first[k]).sum()))
            del first
        return np.array(out, np.int64)


_held: dict[str, Chunks] = {}


def chunks(path: str = TOKENIZER) -> Chunks:
    """This worker's tokenizer for ``path``."""
    if path not in _held:
        _held[path] = Chunks(path)
    return _held[path]
