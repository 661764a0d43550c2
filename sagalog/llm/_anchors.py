"""Content-chosen anchors: every string of SPAN bytes holds one, at a place that its bytes alone decide."""

from __future__ import annotations

import numpy as np

from .common import mix64

SPAN = 100
GRAM = 32
WINDOW = SPAN - GRAM + 1
_PIECE = 1 << 18
_BASE = 0xB492B66FBE98F273
_C = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_TABLES: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for a piece and its overlap."""
    if not _TABLES:
        for x in (_BASE, pow(_BASE, -1, 1 << 64)):
            row = np.full(_PIECE + 2 * SPAN, np.uint64(x))
            row[0] = 1
            _TABLES.append(np.cumprod(row, dtype=np.uint64))
    return _TABLES[0], _TABLES[1]


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    eight = np.lib.stride_tricks.as_strided(raw[: len(raw) - 7].view(np.uint8), (len(raw) - 7, 8), (1, 1))
    eight = np.ascontiguousarray(eight).view(np.uint64).ravel()
    n = len(raw) - GRAM + 1
    out = np.zeros(n, np.uint64)
    for k in range(GRAM // 8):
        part = eight[8 * k : 8 * k + n] * _C[k]
        out = (out ^ (part ^ (part >> np.uint64(32)))) * _C[(k + 1) % 4]
    return mix64(out)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    have, out = 1, x
    while 2 * have <= w:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - have : w - have + len(x) - w + 1])


def runs(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lo, hi, key, content) of one text: strings of SPAN bytes that start at lo .. hi share the anchor with that key.

    ``content`` hashes the bytes lo .. hi + SPAN - 1.  Among equal grams of a
    window the last one is the anchor.
    """
    parts = []
    starts = len(raw) - SPAN + 1
    power, inverse = _powers()
    low_bits = np.uint64((1 << 19) - 1)
    for at in range(0, max(0, starts), _PIECE):
        piece = raw[at : at + _PIECE + SPAN - 1]
        h = _gram_hashes(piece)
        place = np.arange(len(h), dtype=np.uint64)
        best = _sliding_min((h & ~low_bits) | (low_bits - place), WINDOW)
        anchor = (low_bits - (best & low_bits)).astype(np.int64)
        lo = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        hi = np.append(lo[1:], len(anchor)) - 1
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * power[: len(piece)], dtype=np.uint64)])
        content = mix64((prefix[hi + SPAN] - prefix[lo]) * inverse[lo] + (hi - lo).astype(np.uint64))
        parts.append((lo + at, hi + at, h[anchor[lo]], content))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
