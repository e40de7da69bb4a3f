"""Helpers for Arrow batches and numpy arrays inside tasks."""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
import zstandard

from vectorloom.session import small_batches  # noqa: F401  used by the operators

# Maximal runs of anything but ASCII white space.
SPACED_WORD = re.compile(r"[^\x20\x09-\x0D]+")
# Maximal runs of digits, lower-case letters and everything beyond ASCII.
NORMAL_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

_LOWER = {code: code + 32 for code in range(ord("A"), ord("Z") + 1)}


def lower_ascii(text: str) -> str:
    """Lower-case A-Z and nothing else."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def pack(values: np.ndarray) -> bytes:
    """Byte planes of an array, compressed: high bytes of small numbers cost next to nothing."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, dtype: type) -> np.ndarray:
    """The array given to ``pack``."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(dtype).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """``pack`` of the differences of a sorted unsigned array."""
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(data: bytes, dtype: type) -> np.ndarray:
    return np.cumsum(unpack(data, dtype), dtype=dtype)


class WordHashes(dict):
    """64-bit hash of a word, remembered for the words seen most recently."""

    LIMIT = 100_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterable[pa.RecordBatch]:
    """Arrow batches in small pieces: only a few texts are Python strings at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
        pa.default_memory_pool().release_unused()
