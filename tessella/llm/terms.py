"""Words of whole texts as arrays: runs of letters and digits of ASCII and of characters beyond it, A-Z lower-cased.

In UTF-8 such a character is a byte from 0x80 on, so words are runs of bytes, and a table of 256 classes finds them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are analysed together; a longer text is analysed alone, whole.
PIECE = 1 << 20

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], dtype=np.uint8)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = {"powers": np.ones(1, dtype=np.uint64)}


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of all texts end to end, and where each begins (one more at the end); null is empty."""
    texts = texts.fill_null("") if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else texts.fill_null(b"")
    texts = texts.cast(pa.large_binary())
    _, ends, data = texts.buffers()
    begin = np.frombuffer(ends, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return whole[begin[0] : begin[-1]], begin - begin[0]


def pieces(begin: np.ndarray, most: int = PIECE) -> Iterator[slice]:
    """Slices of neighbouring texts, about ``most`` bytes each."""
    i, n = 0, len(begin) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(begin, begin[i] + most, side="right")) - 1))
        yield slice(i, j)
        i = j


def _powers(n: int) -> np.ndarray:
    if len(_POWERS["powers"]) < n:
        _POWERS["powers"] = np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(n, _BASE, dtype=np.uint64)]))
    return _POWERS["powers"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Words:
    """The words of some texts: text number, first byte, bytes, and a 64-bit hash of each, in order."""

    def __init__(self, data: np.ndarray, begin: np.ndarray) -> None:
        self.low = _LOWER[data]
        inside = self.low != 0
        border = np.zeros(len(data) + 1, dtype=bool)
        border[begin] = True
        starts = inside & (np.append(True, ~inside[:-1])[: len(data)] | border[:-1])
        ends = inside & (np.append(~inside[1:], True)[: len(data)] | border[1:])
        self.start = np.flatnonzero(starts)
        self.length = np.flatnonzero(ends) + 1 - self.start
        self.doc = np.searchsorted(begin, self.start, side="right") - 1
        self.hash = np.zeros(0, dtype=np.uint64)
        if len(self.start):
            at = np.arange(len(data))
            at[self.start[0] :] -= np.repeat(self.start, np.diff(np.append(self.start, len(data))))
            at[~inside] = 0
            self.hash = mixed(np.add.reduceat(self.low * _powers(int(self.length.max()) + 1)[at], self.start) + self.length.astype(np.uint64))

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each distinct word its first place among the words; and of each word the number of its distinct one."""
        _, first, number = np.unique(self.hash, return_index=True, return_inverse=True)
        return first, number

    def spelled(self, places: np.ndarray) -> pa.Array:
        """The words at ``places`` as an Arrow array of strings."""
        length = self.length[places]
        ends = np.append(0, np.cumsum(length))
        at = np.arange(ends[-1]) + np.repeat(self.start[places] - ends[:-1], length)
        buffers = [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(self.low[at])]
        return pa.Array.from_buffers(pa.large_string(), len(places), buffers)
