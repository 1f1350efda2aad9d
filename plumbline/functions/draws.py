"""Keyed draws: the same row gets the same draw on any partitioning and after any retry."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_SPAN = 4294967296  # 2**32


def hash_unit(*keys: Column) -> Column:
    """Uniform in [0, 1) from the first 32 bits of an md5 of the keys."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *keys)), 1, 8), 16, 10).cast("long") / F.lit(float(_SPAN))


_CHUNK = 60  # bits of a digest that fit a positive long


def _half_bits(count: Column, word, chunk_bits: int) -> Column:
    """Binomial(count, 1/2): set bits among `count` random bits, one hash per chunk."""

    def hits(chunk: Column) -> Column:
        left = F.least(count - chunk * chunk_bits, F.lit(chunk_bits))
        mask = F.expr("cast(1 as bigint)") * F.pow(F.lit(2.0), left).cast("long") - 1
        return F.bit_count(word(chunk).bitwiseAND(mask)).cast("long")

    chunks = F.sequence(F.lit(0), F.floor((count - 1) / chunk_bits).cast("int"))
    many = F.aggregate(chunks, F.lit(0).cast("long"), lambda acc, c: acc + hits(c))
    zero = F.lit(0).cast("long")
    return F.when(count <= 0, zero).when(count <= chunk_bits, hits(F.lit(0))).otherwise(many)


def binomial_md5(count: Column, keys: list[Column], eps: float) -> Column:
    """Binomial(count, eps) from md5-keyed draws.

    Any engine with md5 reproduces it, so results can be cross-checked in plain SQL. An even
    split counts random bits; any other split sums Bernoulli draws, four per digest.
    """
    if eps == 0.5:
        joined = F.concat_ws("|", *keys)

        def word(chunk: Column) -> Column:
            digest = F.md5(F.concat_ws("|", joined, chunk.cast("string")))
            return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")

        return _half_bits(count, word, _CHUNK)
    cut = int(round(eps * _SPAN))
    blocks = F.sequence(F.lit(0), F.floor((count - 1) / 4).cast("int"))
    prefix = F.concat_ws("|", *keys)

    def block_hits(acc: Column, b: Column) -> Column:
        digest = F.md5(F.concat_ws("|", prefix, b.cast("string")))
        hits = sum(
            F.when(
                (b * 4 + i < count)
                & (F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") < cut),
                1,
            ).otherwise(0)
            for i in range(4)
        )
        return acc + hits.cast("long")

    return F.when(count > 0, F.aggregate(blocks, F.lit(0).cast("long"), block_hits)).otherwise(F.lit(0).cast("long"))


def binomial_xx(count: Column, keys: list[Column], eps: float) -> Column:
    """The cheaper large-scale variant on 64-bit hashes."""
    if eps == 0.5:
        return _half_bits(count, lambda chunk: F.xxhash64(*keys, chunk), _CHUNK)
    cut = int(round(eps * _SPAN))
    blocks = F.sequence(F.lit(0), F.floor((count - 1) / 2).cast("int"))

    def block_hits(acc: Column, b: Column) -> Column:
        h = F.xxhash64(*keys, b)
        low = h.bitwiseAND(F.lit(_SPAN - 1))
        high = F.shiftrightunsigned(h, 32)
        hits = F.when((b * 2 < count) & (low < cut), 1).otherwise(0) + F.when(
            (b * 2 + 1 < count) & (high < cut), 1
        ).otherwise(0)
        return acc + hits.cast("long")

    return F.when(count > 0, F.aggregate(blocks, F.lit(0).cast("long"), block_hits)).otherwise(F.lit(0).cast("long"))


# --- many even splits of a row ---------------------------------------------------------
# `binomial_md5` and `binomial_xx` with eps 0.5 for many seeds at once: the same hashes over arrays, within a task.
_CELLS = 32768  # numbers a step holds at a time
_SHIFTS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * _SPAN)) for i in range(64)]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
_PLACE = [lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: 7 * i % 16]
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _choose(x, y, z, out):
    """Bits of y where x has ones, else of z."""
    np.bitwise_xor(y, z, out=out)
    out &= x
    out ^= z


def _parity(x, y, z, out):
    np.bitwise_xor(x, y, out=out)
    out ^= z


def _either(x, y, z, out):
    np.invert(z, out=out)
    out |= x
    out ^= y


_MIX = [_choose, lambda b, c, d, out: _choose(d, b, c, out), _parity, _either]


def _md5_words(block: list[np.ndarray]) -> np.ndarray:
    """First 60 bits of the md5 of messages of one block each, given as its 16 words."""
    a, b, c, d = (np.full(len(block[0]), x) for x in _START)
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        turn = i // 16
        _MIX[turn](b, c, d, f)
        f += a
        f += block[_PLACE[turn](i)]
        f += _SINES[i]
        r = _SHIFTS[turn][i % 4]
        np.right_shift(f, np.uint32(32 - r), out=g)
        np.left_shift(f, np.uint32(r), out=f)
        f |= g
        f += b
        a, d, c, b, f = d, c, b, f, a
    a, b = (a + _START[0]).byteswap(), (b + _START[1]).byteswap()
    return (a.astype(np.uint64) << np.uint64(28)) | (b >> np.uint32(4))


def _md5_bits(marks: list[bytes], ends: list[bytes]) -> np.ndarray:
    """60 bits of the md5 of every mark followed by every end; all marks are of one length, and all ends."""
    size = len(marks[0]) + len(ends[0])
    if size > 55:
        return np.array([[int(hashlib.md5(m + e).hexdigest()[:15], 16) for e in ends] for m in marks], np.uint64)
    front = np.zeros((len(marks), 64), np.uint8)
    front[:, : len(marks[0])] = np.frombuffer(b"".join(marks), np.uint8).reshape(len(marks), -1)
    back = np.zeros((len(ends), 64), np.uint8)
    back[:, len(marks[0]) : size] = np.frombuffer(b"".join(ends), np.uint8).reshape(len(ends), -1)
    back[:, size] = 0x80
    back[:, 56:58] = np.frombuffer((8 * size).to_bytes(2, "little"), np.uint8)
    front, back = front.view("<u4").T, back.view("<u4").T
    return _md5_words([(f[:, None] | e).ravel() for f, e in zip(front, back, strict=True)]).reshape(len(marks), -1)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _xx_bytes(data: bytes, seed: np.ndarray) -> np.ndarray:
    """XXH64 of up to 31 bytes under many seeds, the last mixing included."""
    h, at = seed + _P5 + np.uint64(len(data)), 0
    while at + 8 <= len(data):
        h = _rotl(h ^ (_rotl(np.frombuffer(data[at : at + 8], "<u8") * _P2, 31) * _P1), 27) * _P1 + _P4
        at += 8
    if at + 4 <= len(data):
        h = _rotl(h ^ (np.frombuffer(data[at : at + 4], "<u4").astype(np.uint64) * _P1), 23) * _P2 + _P3
        at += 4
    for x in data[at:]:
        h = _rotl(h ^ (np.full(1, x, np.uint64) * _P5), 11) * _P1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def xx_int(h: np.ndarray, value: int) -> np.ndarray:
    """xxhash64(..., value) as the column has it, of an int after columns hashed to `h` (uint64)."""
    return _xx_bytes((value & 0xFFFFFFFF).to_bytes(4, "little"), h)


def half_draws(n: np.ndarray, marks: pa.Array, seeds: list[int]) -> np.ndarray:
    """Rows x seeds: Binomial(n, 1/2) as `binomial_md5` (marks are strings) or `binomial_xx` (marks are hashes) draw it.

    `marks` has what `md5_mark` or `xx_mark` make of a row's keys but the seed, which is the last.
    """
    out = np.zeros((len(n), len(seeds)), np.int64)
    texts = pa.types.is_string(marks.type)
    marks = marks.cast(pa.binary()).to_pylist() if texts else marks.to_numpy(zero_copy_only=False).view(np.uint64)
    sizes = np.array([len(m) for m in marks]) if texts else np.zeros(len(n), int)
    names = [str(s).encode() for s in seeds]
    for chunk in range(-(-int(n.max(initial=0)) // _CHUNK)):
        left = np.minimum(n - chunk * _CHUNK, _CHUNK)
        for size in np.unique(sizes[left > 0]):
            rows = np.flatnonzero((left > 0) & (sizes == size))
            for width in {len(x) for x in names}:
                cols = [j for j, x in enumerate(names) if len(x) == width]
                step = max(1, _CELLS // len(cols)) if texts else _CELLS
                for lo in range(0, len(rows), step):
                    at = rows[lo : lo + step]
                    if texts:
                        bits = _md5_bits([marks[i] for i in at], [names[j] + b"|%d" % chunk for j in cols])
                    else:
                        bits = np.stack([_xx_bytes(chunk.to_bytes(4, "little"), _xx_bytes(names[j], marks[at])) for j in cols], axis=1)
                    mask = (np.uint64(1) << left[at].astype(np.uint64)) - np.uint64(1)
                    out[np.ix_(at, cols)] += np.bitwise_count(bits & mask[:, None])
    return out


def md5_mark(keys: list[Column]) -> Column:
    return F.concat_ws("|", *keys, F.lit(""))


def xx_mark(keys: list[Column]) -> Column:
    return F.xxhash64(*keys)
