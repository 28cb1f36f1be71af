"""Word and shingle hashes in numpy, for functions that Spark calls on Arrow batches."""

from __future__ import annotations

import numpy as np
import xxhash

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser: a bijection on 64-bit words."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes | None) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z lower-cased."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, (text or b"").lower().split())), np.uint64)


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words make one shingle."""
    h = word_hashes(text)
    if not len(h):
        return h
    return np.unique(windows(h, min(k, len(h))))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k word hashes: a polynomial in them, mixed at the end."""
    with np.errstate(over="ignore"):
        n = len(h) - k + 1
        out = np.full(n, np.uint64(k), np.uint64)
        for i in range(k):
            out *= GOLDEN
            out += h[i : i + n]
        return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def texts(column) -> list[bytes | None]:
    """The values of an Arrow string column as bytes."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()
