"""Words and hashed shingles of whole texts, for the operators that work inside Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

_STEP = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    """Runs of bytes other than space and x09 to x0D, with A-Z lower-cased; none for a null text."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hashed(tokens: list[bytes]) -> np.ndarray:
    """A 64-bit hash of every word."""
    return np.fromiter(map(xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of ``n`` words; one for the whole sequence if there are fewer words."""
    n = min(n, len(hashes))
    if n == 0:
        return hashes
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out = out * _STEP + hashes[i : len(hashes) - n + 1 + i]
    return mix(out + np.uint64(n))


def multipliers(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of ``count`` hash permutations modulo 2^64."""
    draw = np.random.default_rng(seed)
    factors = draw.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return factors, draw.integers(0, 2**63, count, dtype=np.uint64)


def signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """Arrow lists from one array for each row."""
    ends = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.LargeListArray.from_arrays(ends, pa.array(flat, kind)).cast(pa.list_(kind))
