"""Hashed word shingles of whole texts, for use inside tasks.

Words are runs of anything but the six ASCII blanks; A-Z counts as a-z. All
hashes are 64 bits wide: two different shingles of one pair of texts have the
same hash with a chance of about 1e-12 for texts of a thousand words.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
_SLICE = 1 << 18
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all of them (one to one)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


_VALUE = mixed(np.arange(1, 257, dtype=_U))
_VALUE[65:91] = _VALUE[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_UP, _DOWN = _powers(_BASE, _SLICE + 1), _powers(_INVERSE, _SLICE + 1)
_PLACE = mixed(np.arange(101, 101 + WORDS, dtype=_U)) | _U(1)


def word_hashes(text: str | None) -> np.ndarray:
    """One number for each word of the whole text, in order."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"),
                        np.uint8)
    found, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + _SLICE)
        if end < len(raw):  # cut at a blank; a longer word stays whole
            blanks = np.flatnonzero(_BLANK[raw[at:end]])
            while not len(blanks) and end < len(raw):
                begin, end = end, min(len(raw), end + _SLICE)
                blanks = np.flatnonzero(_BLANK[raw[begin:end]]) + begin - at
            end = at + int(blanks[-1]) + 1 if len(blanks) else len(raw)
        part = raw[at:end]
        inside = np.concatenate(([False], ~_BLANK[part], [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        n = len(part)
        up, down = ((_UP, _DOWN) if n <= _SLICE else
                    (_powers(_BASE, n + 1), _powers(_INVERSE, n + 1)))
        total = np.zeros(n + 1, _U)
        np.cumsum(_VALUE[part] * up[:n], out=total[1:])
        found.append(mixed((total[ends] - total[starts]) * down[starts]))
        at = end
    return np.concatenate(found) if found else np.zeros(0, _U)


def shingle_list(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """A number for each run of n words; fewer words are one run as a whole."""
    if not len(words):
        return words
    size = min(n, len(words))
    count = len(words) - size + 1
    total = np.full(count, size, _U)
    for i in range(size):
        total += words[i:i + count] * _PLACE[i]
    return mixed(total)


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct shingles of a text, sorted; empty without words."""
    return np.unique(shingle_list(word_hashes(text)))
