"""Hashed word shingles of whole texts, in numpy."""

from __future__ import annotations

import numpy as np

SIZE = 5
# ASCII white space, and the lower-case form of ASCII letters.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; equal inputs stay equal, others spread evenly."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: One 64-bit value for each byte, the same for both cases of a letter.
_BYTE = mix((_LOWER + 1).astype(np.uint64) * _BASE)
_POWER = np.cumprod(np.full(256, _BASE, np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words of a text in order: a polynomial over its bytes, ASCII letters lower-cased."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    inside = ~_SPACE[data]
    edge = np.diff(inside, prepend=False, append=False)
    at = np.flatnonzero(edge)
    starts, ends = at[::2], at[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    longest = int(sizes.max())
    power = _POWER if longest <= len(_POWER) else np.cumprod(np.full(longest, _BASE, np.uint64))
    place = np.arange(len(data)) - np.repeat(starts, np.diff(starts, append=len(data))) if starts[0] == 0 else None
    if place is None:
        place = np.arange(len(data) - starts[0]) - np.repeat(starts - starts[0], np.diff(starts, append=len(data)))
        data, inside = data[starts[0] :], inside[starts[0] :]
    value = np.where(inside, _BYTE[data] * power[np.minimum(place, longest - 1)], np.uint64(0))
    return mix(np.add.reduceat(value, starts - starts[0]) + sizes.astype(np.uint64))


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """Distinct hashed shingles of `size` lower-cased words, sorted; a shorter text is one shingle."""
    h = word_hashes(text or "")
    if not len(h):
        return h
    size = min(size, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        out = (out ^ (out >> np.uint64(32))) * _BASE + h[i : len(h) - size + 1 + i]
    out = mix(out)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def set_key(grams: np.ndarray) -> int:
    """A signed 64-bit key of the set as a whole."""
    total = mix(grams + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64)
    return int((total + np.uint64(len(grams))).astype(np.int64))
