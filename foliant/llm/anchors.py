"""Anchors of byte windows: of each window the place of its smallest hashed k-gram, so that equal windows have equal anchors."""

from __future__ import annotations

import numpy as np

from .shingles import _powers, mix

_U = np.uint64
GRAM = 32
CHUNK = 1 << 20
_PLACE = _U((1 << 24) - 1)


def gram_hashes(text: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the k-gram at each place, in chunks so that powers stay few."""
    n = len(text) - gram + 1
    if n <= 0:
        return np.empty(0, _U)
    parts = []
    for at in range(0, n, CHUNK):
        own = text[at : min(at + CHUNK, n) + gram - 1]
        up, down = _powers.upto(len(own) + 1)
        total = np.zeros(len(own) + 1, _U)
        np.cumsum((own.astype(_U) + _U(1)) * up[: len(own)], out=total[1:])
        m = len(own) - gram + 1
        parts.append(mix((total[gram:] - total[:m]) * down[:m]))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by doubling."""
    have, out = 1, x
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return out if have == w else np.minimum(out[: len(x) - w + 1], out[w - have : w - have + len(x) - w + 1])


def anchors(text: bytes, window: int = 100, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors that a text's windows have: place, hash, first and last window start of each run; no windows, no anchors."""
    if len(text) < window:
        return (np.empty(0, np.int64), np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.int64))
    hashes = gram_hashes(np.frombuffer(text, np.uint8), gram)
    w = window - gram + 1
    places, starts = [], []
    block = int(_PLACE) - w
    for at in range(0, len(hashes) - w + 1, block):
        own = hashes[at : at + block + w - 1]
        low = _sliding_min((own & ~_PLACE) | np.arange(len(own), dtype=_U), w) & _PLACE
        new = np.flatnonzero(np.diff(low, prepend=low[0] + _U(1)))
        if at and places and low[0] + at == places[-1][-1]:
            new = new[1:]
        places.append(low[new].astype(np.int64) + at)
        starts.append(new + at)
    place, first = np.concatenate(places), np.concatenate(starts)
    last = np.append(first[1:] - 1, len(hashes) - w)
    return place, hashes[place], first, last
