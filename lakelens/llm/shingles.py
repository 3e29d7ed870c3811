"""Sets of hashed word shingles."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: multiply and shift, twice."""
    with np.errstate(over="ignore"):
        x = x ^ U((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
        x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
        return x ^ (x >> U(32))


def words(text: str | None) -> list[bytes]:
    """Words without ASCII white space, A-Z lower-cased; bytes.lower() and bytes.split() know ASCII only."""
    return (text or "").encode().lower().split()


def shingle_set(ws: list[bytes], n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; of fewer words, the whole sequence as one."""
    if not ws:
        return np.zeros(0, U)
    h = np.fromiter(map(xxhash.xxh64_intdigest, ws), U, len(ws))
    k = min(n, len(ws))
    with np.errstate(over="ignore"):
        out = np.full(len(ws) - k + 1, U(k))
        for j in range(k):
            out = mix(out, 7) + h[j : len(h) - k + 1 + j]
    return np.unique(mix(out, 11))


def bitmap(s: np.ndarray, bits: int = 1024) -> np.ndarray:
    """One bit for each hash, as 64-bit words."""
    out = np.zeros(bits, np.uint8)
    out[(s % U(bits)).astype(np.int64)] = 1
    return np.packbits(out).view(U)
