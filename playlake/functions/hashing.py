"""Hashes used for reproducible randomness and feature hashing.

``md5_u32`` is the cross-engine deterministic hash: the first 8 hex digits of
md5(text) read as an unsigned 32-bit integer.  It gives identical numbers in
Spark and in plain SQL engines, so samples and splits can be checked exactly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO60 = float(2 ** 60)


def md5_u32(*parts) -> Column:
    """md5 of the ':'-joined parts -> integer in [0, 2^32)."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.concat_ws(":", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def md5_u60(*parts) -> Column:
    """As :func:`md5_u32`, from 15 hex digits: an integer in [0, 2^60), for draws among many rows."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.concat_ws(":", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def md5_uniform(*parts) -> Column:
    """Uniform (0, 1) number from md5_u60."""
    return (md5_u60(*parts) + F.lit(0.5)) / F.lit(TWO60)


def murmur3_32(data: bytes, seed: int = 0) -> int:
    """Signed MurmurHash3 x86 32-bit (public algorithm) of a byte string."""
    c1, c2 = 0xCC9E2D51, 0x1B873593
    h = seed & 0xFFFFFFFF
    n = len(data)
    nblocks = n // 4
    for i in range(nblocks):
        k = int.from_bytes(data[4 * i:4 * i + 4], "little")
        k = (k * c1) & 0xFFFFFFFF
        k = ((k << 15) | (k >> 17)) & 0xFFFFFFFF
        k = (k * c2) & 0xFFFFFFFF
        h ^= k
        h = ((h << 13) | (h >> 19)) & 0xFFFFFFFF
        h = (h * 5 + 0xE6546B64) & 0xFFFFFFFF
    tail = data[4 * nblocks:]
    k = 0
    if len(tail) >= 3:
        k ^= tail[2] << 16
    if len(tail) >= 2:
        k ^= tail[1] << 8
    if len(tail) >= 1:
        k ^= tail[0]
        k = (k * c1) & 0xFFFFFFFF
        k = ((k << 15) | (k >> 17)) & 0xFFFFFFFF
        k = (k * c2) & 0xFFFFFFFF
        h ^= k
    h ^= n
    h ^= h >> 16
    h = (h * 0x85EBCA6B) & 0xFFFFFFFF
    h ^= h >> 13
    h = (h * 0xC2B2AE35) & 0xFFFFFFFF
    h ^= h >> 16
    return h - (1 << 32) if h & 0x80000000 else h


def signed_hash_vector(token: str, n: int) -> list[int]:
    """One-hot signed vector of width n for one token (feature hashing).

    slot = |h| mod n, sign = +1 when h >= 0; h = -2^31 maps to the slot of
    2^31 - 1 - (n - 1), as in the common open-source hasher.
    """
    h = murmur3_32(token.encode("utf-8"), 0)
    if h == -2147483648:
        slot = (2147483647 - (n - 1)) % n
    else:
        slot = abs(h) % n
    vec = [0] * n
    vec[slot] = 1 if h >= 0 else -1
    return vec
