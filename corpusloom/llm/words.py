"""Words of a text as 64-bit hashes, vectorised, in memory bounded whatever the text's length.

A word is a run without ASCII white space. Its hash is a polynomial over its bytes modulo 2^64,
read off prefix sums of one piece of text, then mixed with the length. Words that cross pieces
are put together from their parts, so the result doesn't depend on where pieces end.
"""

from __future__ import annotations

import numpy as np

from ..sources.shipping import ship
from .shared import worker_state

ship(__name__)

PIECE = 1 << 18
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
#: Name of the tables of powers among a worker's objects.
STATE = "word_powers"


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    def make():
        power = np.cumprod(np.full(PIECE + 1, BASE, np.uint64)) * np.uint64(pow(BASE, -1, 1 << 64))
        inverse = np.cumprod(np.full(PIECE + 1, pow(BASE, -1, 1 << 64), np.uint64)) * np.uint64(BASE)
        blank = np.zeros(256, bool)
        blank[[0x20, *range(0x09, 0x0E)]] = True
        return power, inverse, blank

    return worker_state(STATE, make)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """One uint64 for each word of ``data``, in order."""
    power, inverse, blank = _tables()
    done, open_hash, open_len = [], 0, 0
    for at in range(0, len(data), PIECE):
        piece = np.frombuffer(data, np.uint8, min(PIECE, len(data) - at), at)
        edge = np.empty(len(piece) + 2, bool)
        edge[0] = edge[-1] = True
        edge[1:-1] = blank[piece]
        bounds = np.flatnonzero(edge[1:] != edge[:-1])
        start, end = bounds[::2], bounds[1::2]
        if open_len and not (len(start) and start[0] == 0):
            done.append(mix(np.array([(open_hash ^ (open_len << 48)) & MASK], np.uint64)))
            open_hash = open_len = 0
        if not len(start):
            continue
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * power[: len(piece)], out=sums[1:])
        raw = (sums[end] - sums[start]) * inverse[start]
        size = (end - start).astype(np.uint64)
        if open_len:
            raw[0] = (open_hash + pow(BASE, open_len, 1 << 64) * int(raw[0])) & MASK
            size[0] += np.uint64(open_len)
            open_hash = open_len = 0
        if end[-1] == len(piece):
            open_hash, open_len = int(raw[-1]), int(size[-1])
            raw, size = raw[:-1], size[:-1]
        done.append(mix(raw ^ (size << np.uint64(48))))
    if open_len:
        done.append(mix(np.array([(open_hash ^ (open_len << 48)) & MASK], np.uint64)))
    return np.concatenate(done) if done else np.zeros(0, np.uint64)


def run_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash for each run of ``k`` consecutive words (none if there are fewer)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = np.zeros(n, np.uint64)
    factor = np.uint64((BASE * (2 * seed + 1)) & MASK)
    for i in range(k):
        x = x * factor + words[i : i + n]
    return mix(x ^ np.uint64((seed * 0xD6E8FEB86659FD93) & MASK))
