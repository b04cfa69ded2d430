"""Pseudonymising hashes and checksums."""

from __future__ import annotations

import hashlib
import hmac

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def salted(x: Column, salt: str, method: str = "sha256") -> Column:
    """Hex digest of the salt followed by the text."""
    joined = F.concat(F.lit(salt), x.cast("string"))
    if method == "md5":
        return F.md5(joined)
    return F.sha2(joined, {"sha256": 256, "sha512": 512}[method])


def keyed(key: str, method: str = "sha256"):
    """Arrow UDF: HMAC of the text under a secret key, in hex."""
    secret = key.encode()

    def work(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: None if s is None else hmac.new(secret, s.encode(), method).hexdigest())

    return F.pandas_udf(work, "string")


def make_hasher(method: str, key: str):
    """A keyed hash by name: HMAC_MD5, HMAC_SHA256 (also for no name) or HMAC_SHA512; plain digests are refused."""
    known = {"": "sha256", "HMAC_MD5": "md5", "HMAC_SHA256": "sha256", "HMAC_SHA512": "sha512"}
    if method not in known:
        raise ValueError(f"not a keyed hash: {method!r}")
    return keyed(key, known[method])


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return x << np.uint32(n) | x >> np.uint32(32 - n)


def murmur3_many(values: list[bytes], seed: int = 0) -> np.ndarray:
    """MurmurHash3 (x86, 32 bits) of many values at once: block k of all that have one, then all tails."""
    sizes = np.array([len(v) for v in values], np.int64)
    width = int(-(-max([4, *sizes.tolist()]) // 4))
    padded = np.frombuffer(b"".join(v.ljust(4 * width, b"\0") for v in values), "<u4").reshape(len(values), width)
    h = np.full(len(values), seed, np.uint32)

    def scrambled(k: np.ndarray) -> np.ndarray:
        return _rotated(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)

    for block in range(width):
        whole = sizes >= 4 * (block + 1)
        if whole.any():
            h[whole] = _rotated(h[whole] ^ scrambled(padded[whole, block]), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    tail = np.flatnonzero(sizes % 4)
    h[tail] ^= scrambled(padded[tail, sizes[tail] // 4])
    h ^= sizes.astype(np.uint32)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return h ^ h >> np.uint32(16)


def murmur32(seed: int = 0):
    """Arrow UDF: signed 32-bit MurmurHash3 of the text in UTF-8."""

    def work(texts: pd.Series) -> pd.Series:
        out = pd.Series(np.zeros(len(texts), np.int32))
        known = texts.notna().to_numpy()
        if known.any():
            out[known] = murmur3_many([s.encode() for s in texts[known]], seed).view(np.int32)
        return out.astype("Int32").where(known)

    return F.pandas_udf(work, "int")


def _rotated64(x: np.ndarray, n: int) -> np.ndarray:
    return x << np.uint64(n) | x >> np.uint64(64 - n)


def _finished64(x: np.ndarray) -> np.ndarray:
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ x >> np.uint64(33)) * np.uint64(factor)
    return x ^ x >> np.uint64(33)


def murmur3_128_many(values: list[bytes], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """MurmurHash3 (x64, 128 bits) of many values at once, as low and high halves: block k of all that have one, then all
    tails (an empty tail mixes in nothing)."""
    sizes = np.array([len(v) for v in values], np.int64)
    width = int(max([0, *sizes.tolist()])) // 16 + 1
    words = np.frombuffer(b"".join(v.ljust(16 * width, b"\0") for v in values), "<u8").reshape(len(values), width, 2)
    low, high = np.full(len(values), seed, np.uint64), np.full(len(values), seed, np.uint64)
    c, d = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)
    first, second = lambda k: _rotated64(k * c, 31) * d, lambda k: _rotated64(k * d, 33) * c
    for block in range(width):
        own = np.flatnonzero(sizes >= 16 * (block + 1))
        if not len(own):
            break
        a, b = low[own], high[own]
        a = (_rotated64(a ^ first(words[own, block, 0]), 27) + b) * np.uint64(5) + np.uint64(0x52DCE729)
        b = (_rotated64(b ^ second(words[own, block, 1]), 31) + a) * np.uint64(5) + np.uint64(0x38495AB5)
        low[own], high[own] = a, b
    tail = words[np.arange(len(values)), sizes // 16]
    low ^= first(tail[:, 0])
    high ^= second(tail[:, 1])
    low ^= sizes.astype(np.uint64)
    high ^= sizes.astype(np.uint64)
    low = low + high
    high = high + low
    low, high = _finished64(low), _finished64(high)
    low = low + high
    return low, high + low


def murmur64(seed: int = 0):
    """Arrow UDF: signed low half of the 128-bit MurmurHash3 (x64) of the text in UTF-8."""

    def work(texts: pd.Series) -> pd.Series:
        out = pd.Series(np.zeros(len(texts), np.int64))
        known = texts.notna().to_numpy()
        if known.any():
            out[known] = murmur3_128_many([s.encode() for s in texts[known]], seed)[0].view(np.int64)
        return out.astype("Int64").where(known)

    return F.pandas_udf(work, "bigint")


def file_digest(content: Column) -> Column:
    """MD5 of bytes."""
    return F.md5(content)


def blake(size: int = 16):
    """Arrow UDF: BLAKE2b of the text, in hex."""

    def work(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: None if s is None else hashlib.blake2b(s.encode(), digest_size=size).hexdigest())

    return F.pandas_udf(work, "string")


def to_signed(value: Column, bits: int) -> Column:
    """An unsigned number of so many bits read as two's complement."""
    v = value.cast("decimal(20,0)")
    return F.when(v >= F.lit(1 << (bits - 1)).cast("decimal(20,0)"), v - F.lit(1 << bits).cast("decimal(20,0)")).otherwise(v)


def to_unsigned(value: Column, bits: int) -> Column:
    v = value.cast("decimal(20,0)")
    return F.when(v < 0, v + F.lit(1 << bits).cast("decimal(20,0)")).otherwise(v)


#: Factors, rotations and summands of MurmurHash3 (x86, 128 bits), a lane each.
_FACTORS = (0x239B961B, 0xAB0E9789, 0x38B34AE5, 0xA1E38B93)
_TURNS, _LANE_TURNS = (15, 16, 17, 18), (19, 17, 15, 13)
_SUMMANDS = (0x561CCD1B, 0x0BCAA747, 0x96CD1C35, 0x32AC3B17)


def murmur3_x86_128_many(values: list[bytes], seed: int = 0) -> np.ndarray:
    """MurmurHash3 (x86, 128 bits) of many values at once: four lanes of 32 bits each, the lowest first."""
    sizes = np.array([len(v) for v in values], np.int64)
    width = int(max([0, *sizes.tolist()])) // 16 + 1
    words = np.frombuffer(b"".join(v.ljust(16 * width, b"\0") for v in values), "<u4").reshape(len(values), width, 4)
    lanes = np.full((4, len(values)), seed, np.uint32)
    turned = lambda x, n: x << np.uint32(n) | x >> np.uint32(32 - n)
    mixed = lambda k, j: turned(k * np.uint32(_FACTORS[j]), _TURNS[j]) * np.uint32(_FACTORS[(j + 1) % 4])
    for block in range(width):
        own = np.flatnonzero(sizes >= 16 * (block + 1))
        if not len(own):
            break
        for j in range(4):
            h = turned(lanes[j, own] ^ mixed(words[own, block, j], j), _LANE_TURNS[j])
            lanes[j, own] = (h + lanes[(j + 1) % 4, own]) * np.uint32(5) + np.uint32(_SUMMANDS[j])
    tail = words[np.arange(len(values)), sizes // 16]  # an empty tail mixes in nothing
    for j in range(4):
        lanes[j] ^= mixed(tail[:, j], j) ^ sizes.astype(np.uint32)
    for finish in (True, False):
        lanes[0] += lanes[1] + lanes[2] + lanes[3]
        lanes[1:] += lanes[0]
        if finish:
            for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
                lanes = (lanes ^ lanes >> np.uint32(shift)) * np.uint32(factor)
            lanes ^= lanes >> np.uint32(16)
    return lanes.T


def murmur128_x86(seed: int = 0):
    """Arrow UDF: the 128-bit MurmurHash3 (x86) of the text in UTF-8, as 32 hex digits, the highest lane first."""

    def work(texts: pd.Series) -> pd.Series:
        known = texts.dropna()
        found = murmur3_x86_128_many([s.encode() for s in known], seed)[:, ::-1] if len(known) else []
        return pd.Series(["".join(f"{x:08x}" for x in row) for row in found], known.index, dtype=object).reindex(texts.index).where(texts.notna(), None)

    return F.pandas_udf(work, "string")
