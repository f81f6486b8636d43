"""Number arrays as compressed binary columns, and keys dealt to parts by their range."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import zstandard

from sievelab.llm.wordhash import U


def squeeze(values: np.ndarray) -> bytes:
    """Numbers as byte planes, compressed; planes of zeros cost nothing."""
    width = values.dtype.itemsize
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unsqueeze(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).reshape(-1)


def squeeze_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as differences."""
    return squeeze(np.diff(keys, prepend=U(0)))


def unsqueeze_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(data, U), dtype=U)


def key_ranges(keys: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """(part, first, end): ranges of ascending keys that belong to each part."""
    cuts = np.searchsorted(keys, np.array([(i << 64) // parts for i in range(parts)], U)).tolist()
    for part, (low, high) in enumerate(zip(cuts, [*cuts[1:], len(keys)])):
        if high > low:
            yield part, low, high
