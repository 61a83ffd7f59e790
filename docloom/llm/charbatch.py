"""Texts as one flat array of code points, for operators that work in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

TOP = 0x110000


@lru_cache(maxsize=1)
def alnum_table() -> np.ndarray:
    """For each code point whether it is a letter or digit."""
    return np.fromiter((chr(i).isalnum() for i in range(TOP)), np.bool_, TOP)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64: a fixed random-looking 64-bit value for each number."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


@lru_cache(maxsize=1)
def char_hashes() -> np.ndarray:
    return mix(np.arange(TOP, dtype=np.uint64))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def batches(texts: list[str], budget: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges (from, to) of texts with about `budget` characters each: bounds memory whatever the batch size of Arrow. A longer text is a range of its own."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > budget:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each followed by a line end, and the start of each text plus the total."""
    codes = code_points("\n".join(texts) + "\n") if texts else np.zeros(0, np.uint32)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return codes, starts


def word_bounds(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of letters and digits. The last code must not be one."""
    word = alnum_table()[codes]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(word) and word[0]:
        edge = np.concatenate([[0], edge])
    return edge[0::2], edge[1::2]


@lru_cache(maxsize=64)
def _powers(n: int, base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[1], np.full(n - 1, base)]).astype(np.uint64), dtype=np.uint64)


def word_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word."""
    if not len(start):
        return np.zeros(0, np.uint64)
    lengths = end - start
    total = int(lengths.sum())
    offset = np.zeros(len(start), np.int64)
    np.cumsum(lengths[:-1], out=offset[1:])
    inner = np.arange(total, dtype=np.int64) - np.repeat(offset, lengths)
    at = inner + np.repeat(start, lengths)
    top = 1 << int(max(6, int(lengths.max()).bit_length()))
    with np.errstate(over="ignore"):
        value = char_hashes()[codes[at]] * _powers(top, 0x5851F42D4C957F2D)[inner]
        return mix(np.add.reduceat(value, offset) + lengths.astype(np.uint64))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive words (runs over a text's end must be masked by the caller)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    base = np.uint64(0xD6E8FEB86659FD93)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * base + words[k : k + m]
    return out
