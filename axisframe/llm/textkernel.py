"""Words and hashes of whole Arrow string columns with numpy, without a Python object per word."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**64, 256, dtype=U)
_BASE = U(int(_RNG.integers(1, 2**64, dtype=U)) | 1)
_BACK = U(pow(int(_BASE), -1, 2**64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list = [np.ones(1, U), np.ones(1, U)]


def release() -> None:
    """Give freed memory back to the system: workers live on between tasks, beside others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run):
    """A worker's generator over batches that releases memory when it ends."""

    @wraps(run)
    def inside(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return inside


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; its argument is not kept."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _BACK)):
                a = np.full(n, base, U)
                a[0] = 1
                _powers[k] = np.multiply.accumulate(a)
    return _powers[0][:n], _powers[1][:n]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and the offsets of each; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary() if pa.types.is_binary(texts.type) else pa.large_string())
    texts = pc.fill_null(texts, b"" if pa.types.is_large_binary(texts.type) else "")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows with about ``most`` bytes of text each, so that memory stays bounded."""
    if not batch.num_rows:
        return
    at = batch.schema.get_field_index(column)
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(sizes) // most
    cuts = np.flatnonzero(np.diff(run)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a column: start, end and row of each, in order."""

    def __init__(self, texts: pa.Array):
        self.buf, self.off = flat(texts)
        self.rows = len(self.off) - 1
        inside = ~IS_SPACE[self.buf]
        n = len(self.buf)
        edge = np.zeros(n + 1, bool)
        edge[self.off[self.off <= n]] = True
        before = np.ones(n, bool)
        before[1:] = ~inside[:-1]
        after = np.ones(n, bool)
        after[:-1] = ~inside[1:]
        self.start = np.flatnonzero(inside & (before | edge[:-1]))
        self.end = np.flatnonzero(inside & (after | edge[1:])) + 1
        #: Words of row r are first[r]:first[r + 1].
        self.first = np.searchsorted(self.start, self.off)
        self.count = np.diff(self.first)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.count)

    def hashes(self, lower: bool = True) -> np.ndarray:
        """A 64-bit hash of each word; A-Z count as a-z if ``lower``."""
        n = len(self.buf)
        power, back = _power(n + 1)
        with np.errstate(over="ignore"):
            c = np.zeros(n + 1, U)
            np.cumsum(_BYTE[LOWER[self.buf] if lower else self.buf] * power[:n], out=c[1:])
            h = (c[self.end] - c[self.start]) * back[self.start]
            return mix(h + (self.end - self.start).astype(U))
