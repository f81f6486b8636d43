"""Words of a column of texts as 64-bit hashes, without a Python step per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64

#: A-Z become a-z and white space becomes a blank.
FOLD = bytes(32 if b in (9, 10, 11, 12, 13) else b + 32 if 65 <= b <= 90 else b for b in range(256))
FOLD_TABLE = np.frombuffer(FOLD, np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A well mixing permutation of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of each text after lower-casing A-Z, one text after another, and
    their number in each text; null texts have none."""
    column = pc.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    raw = FOLD_TABLE[np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]]] if body is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    blank = raw == 32
    begins = np.zeros(len(raw), bool)
    begins[1:] = blank[:-1] & ~blank[1:]
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, U), np.zeros(len(column), np.int64)
    words = pa.StringArray.from_buffers(
        len(starts), pa.py_buffer(np.append(starts, len(raw)).astype(np.int32)), pa.py_buffer(raw)
    ).dictionary_encode()
    names = [w.rstrip(b" ") for w in words.dictionary.cast(pa.binary()).to_pylist()]
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in names), U, len(names))
    real = np.fromiter(map(bool, names), bool, len(names))
    codes = words.indices.to_numpy()
    kept = real[codes]
    owner = np.searchsorted(offsets, starts[kept], side="right") - 1
    return hashes[codes[kept]], np.bincount(owner, minlength=len(column))
