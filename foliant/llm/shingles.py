"""Word shingles as 64-bit hashes, whole texts at a time in numpy."""

from __future__ import annotations

import re

import numpy as np

_U = np.uint64
_BASE, _STEP, _LENGTH = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
CHUNK = 1 << 20


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


class _Powers:
    """Powers of the base and of its inverse, as many as the longest chunk so far needs."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                both = []
                for base in (int(_BASE), _inverse(int(_BASE))):
                    x = np.full(size, base, _U)
                    x[0] = 1
                    both.append(np.multiply.accumulate(x))
            self.up, self.down = both
        return self.up, self.down


_powers = _Powers()


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _chunk_words(text: bytes) -> np.ndarray:
    a = np.frombuffer(text, np.uint8)
    edge = np.diff(_IS_SPACE[a].astype(np.int8), prepend=1, append=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers.upto(len(a) + 1)
    total = np.zeros(len(a) + 1, _U)
    np.cumsum((a.astype(_U) + _U(1)) * up[: len(a)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U) * _LENGTH)


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; long texts go through in chunks cut between words."""
    text = text.lower()  # of bytes: A-Z alone
    if len(text) <= CHUNK:
        return _chunk_words(text)
    parts, at = [], 0
    while at < len(text):
        cut = _SPACE.search(text, at + CHUNK)
        end = cut.end() if cut else len(text)
        parts.append(_chunk_words(text[at:end]))
        at = end
    return np.concatenate(parts)


def shingle_set(text: bytes | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles; of fewer words than that, one hash of them all; none of no words."""
    if not text:
        return np.empty(0, _U)
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(size, len(w))
    h = np.full(len(w) - n + 1, _U(n))
    for j in range(n):
        h = h * _STEP + w[j : len(w) - n + 1 + j]
    h = np.sort(mix(h))
    return h[np.concatenate(([True], h[1:] != h[:-1]))]
