"""Arrays as compressed blocks, and their dealing to hash partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from gridlark.llm.common import mix


def zip_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block: lengths, then planes of bytes."""
    import zstandard

    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts.append(np.array([len(a), a.dtype.itemsize], np.int64).tobytes() + np.frombuffer(a.tobytes(), np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unzip_arrays(block: bytes, *kinds) -> list[np.ndarray]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(block)
    out, at = [], 0
    for kind in kinds:
        n, size = np.frombuffer(data, np.int64, 2, at)
        at += 16
        out.append(np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T.copy().view(kind).reshape(-1))
        at += int(n * size)
    return out


def deal(part: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, indexes of its members in their order) of each part from 0 to n - 1 that has any."""
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(n + 1))
    for i in np.flatnonzero(np.diff(cut)).tolist():
        yield i, order[cut[i] : cut[i + 1]]


def part_of(key: np.ndarray, n: int) -> np.ndarray:
    """The part of each 64-bit key."""
    return ((mix(key) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
