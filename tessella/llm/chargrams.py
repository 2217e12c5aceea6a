"""Hashed character n-grams of whole texts, computed by numpy over code points."""

from __future__ import annotations

import unicodedata

import numpy as np

_SPACE = 32
_STEP = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917), np.uint32(668265263), np.uint32(374761393), np.uint32(1540483477))
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point -> itself for letters and marks, else a space (Basic Multilingual Plane)."""
    if not _LETTERS:
        _LETTERS.append(np.array([c if unicodedata.category(chr(c))[0] in "LM" else _SPACE for c in range(65536)], dtype=np.uint32))
    return _LETTERS[0]


def has_letter(codes: np.ndarray) -> bool:
    """Whether one of some lower-case code points is a letter (category L); marks alone, as of emoji, are none."""
    if len(_LETTERS) < 2:
        _letters()
        _LETTERS.append(np.array([unicodedata.category(chr(c))[0] == "L" for c in range(65536)]))
    return bool(_LETTERS[1][np.minimum(codes, 65535)].any()) or any(chr(c).isalpha() for c in codes[codes > 65535].tolist())


def letter_codes(text: str | None) -> np.ndarray:
    """Lower-case code points of the letters, words set apart by one space, a space at either end; empty if no letter or mark."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    folded = _letters()[np.minimum(points, 65535)]
    for at in np.flatnonzero(points > 65535):
        folded[at] = points[at] if chr(points[at]).isalpha() else _SPACE
    inner = np.empty(len(folded) + 2, dtype=np.uint32)
    inner[0] = inner[-1] = _SPACE
    inner[1:-1] = folded
    blank = inner == _SPACE
    kept = np.ones(len(inner), dtype=bool)
    kept[1:] = ~(blank[1:] & blank[:-1])
    out = inner[kept]
    return out if len(out) > 2 else out[:0]


def gram_slots(codes: np.ndarray, orders: tuple[int, ...], bits: int, within_words: bool) -> np.ndarray:
    """Slots below 2**bits of every n-gram; with ``within_words``, a space stands only at an n-gram's ends."""
    found = []
    blank = codes == _SPACE
    shift = np.uint32(32 - bits)
    for n in orders:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        mixed = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
        for j in range(n):
            mixed = (mixed ^ codes[j : j + m]) * _STEP[j % len(_STEP)]
            mixed ^= mixed >> np.uint32(15)
        if within_words:
            broken = np.zeros(m, dtype=bool)
            for j in range(1, n - 1):
                broken |= blank[j : j + m]
            mixed = mixed[~broken]
        found.append((mixed * _STEP[0]) >> shift)
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint32)
