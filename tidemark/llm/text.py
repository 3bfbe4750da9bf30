"""Words of many texts at once, and hashes of them, with NumPy inside a task.

Words are maximal runs of bytes outside a set of breaks, taken from the UTF-8
form; breaks are ASCII, so no character is cut.  A text is never truncated: a
block holds whole texts, and a text longer than the block size is a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np

BLOCK_BYTES = 1 << 20
LONG_WORD = 512
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def blocks(sizes: Iterable[int], limit: int = BLOCK_BYTES) -> Iterator[slice]:
    """Consecutive slices of rows of about `limit` bytes, each of one row at least."""
    start, total, i = 0, 0, -1
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield slice(start, i)
            start, total = i, 0
        total += size + 1
    if i >= start:
        yield slice(start, i + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the published splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of a list of UTF-8 texts: byte ranges in `buffer`, and `first[d]:first[d + 1]` are those of text d."""

    def __init__(self, texts: list[bytes], fold: bool = False, breaks: np.ndarray = _WHITE):
        self.buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        if fold:
            upper = (self.buffer >= 65) & (self.buffer <= 90)
            self.buffer = self.buffer + upper.astype(np.uint8) * np.uint8(32)
        gap = breaks[self.buffer]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], gap)).astype(np.int8)))
        self.starts, self.ends = edge[0::2], edge[1::2]
        places = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.starts, places)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        size = self.ends - self.starts
        order = np.argsort(-np.minimum(size, LONG_WORD).astype(np.int16), kind="stable")
        start, size = self.starts[order], size[order]
        value = size.astype(np.uint64)
        usual = value.copy()
        reach = np.searchsorted(-np.minimum(size, LONG_WORD), -np.arange(min(LONG_WORD, int(size[0]) if len(size) else 0)), side="left")
        for i, n in enumerate(reach):
            value[:n] = value[:n] * _BASE + self.buffer[start[:n] + i]
        for w in range(int(np.searchsorted(-usual.astype(np.int64), -LONG_WORD, side="left"))):
            value[w] = int.from_bytes(hashlib.blake2b(self.buffer[start[w] : start[w] + int(size[w])].tobytes(), digest_size=8).digest(), "little")
        out = np.empty(len(order), np.uint64)
        out[order] = mix(value)
        return out


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every run of k words; a text of fewer words but not none gives its whole sequence."""
    n = len(words)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    value = np.full(n, k, np.uint64)
    for i in range(min(k, n)):  # with fewer than k words in all, no run is whole
        value[: n - i] = value[: n - i] * _BASE + words[i:]
    whole = np.arange(n) + k <= first[1:][text]
    value, owner = mix(value[whole]), text[whole]
    short = np.flatnonzero((np.diff(first) < k) & (np.diff(first) > 0))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for j, d in enumerate(short):
            x = np.uint64(int(first[d + 1] - first[d]))
            with np.errstate(over="ignore"):
                for w in words[first[d] : first[d + 1]]:
                    x = x * _BASE + w
            extra[j] = x
        value, owner = np.concatenate((value, mix(extra))), np.concatenate((owner, short))
        order = np.argsort(owner, kind="stable")
        value, owner = value[order], owner[order]
    return value, owner
