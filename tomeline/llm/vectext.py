"""Vectorised words and hashes over Arrow string columns.

A word is a longest run of bytes other than space and 0x09-0x0D, which in UTF-8
is the same as the regular expression [^\\x20\\x09-\\x0D]+ over code points.
All functions work on slices of at most SLICE_BYTES of text (one longer text is
a slice of its own), so a task's memory does not follow its input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2_000_000

_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of names and numbers: ASCII letters and digits, and all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.Generator(np.random.PCG64(20_240_501))
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASE_A = np.uint64(0x9E3779B97F4A7C15)
BASE_B = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values over the whole word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of bounded text size."""
    if not batch.num_rows:
        return
    size = np.cumsum(text_lengths(batch.column(column)))
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, before + SLICE_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def text_lengths(col: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def raw_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts end to end as bytes, and the n + 1 offsets; null is empty."""
    if not pa.types.is_string(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("")
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


@dataclass
class Words:
    """Every word of a slice, in order: its row, its bytes and a 64-bit hash."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    data: np.ndarray
    counts: np.ndarray

    def __len__(self) -> int:
        return len(self.row)


def words(col: pa.Array, lower: bool = False, made_of: np.ndarray | None = None) -> Words:
    """made_of: the bytes that words consist of (default: all but white space)."""
    data, offs = raw_bytes(col)
    if lower:
        data = _LOWER[data]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(0, np.uint64), data, np.zeros(len(col), np.int64))
    ink = ~_WS[data] if made_of is None else made_of[data]
    ws = ~ink
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    left, right = edge[:-1].copy(), edge[1:].copy()
    left[1:] |= ws[:-1]
    right[:-1] |= ws[1:]
    start = np.flatnonzero(ink & left)
    end = np.flatnonzero(ink & right) + 1
    row = np.searchsorted(offs, start, "right") - 1
    counts = np.bincount(row, minlength=len(col)).astype(np.int64)
    return Words(row, start, end, span_hash(data[ink], end - start), data, counts)


def span_hash(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each of the consecutive byte runs that make up data."""
    if not len(lengths):
        return np.zeros(0, np.uint64)
    first = np.cumsum(lengths) - lengths
    rel = np.arange(len(data)) - np.repeat(first, lengths)
    value = _BYTE[data] * powers(BASE_B, int(lengths.max()))[rel]
    return mix(np.add.reduceat(value, first) + lengths.astype(np.uint64))


def grams(h: np.ndarray, k: int, base: np.uint64) -> np.ndarray:
    """Hash of each k consecutive words; entry i covers words i .. i + k - 1.

    Entries that cross rows have to be masked by the caller.
    """
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have, power, step, length = None, 0, h, base, 1
    while True:  # doubling: runs of 1, 2, 4, ... words are put together
        if k & length:
            part = power[have : have + n]
            out = part.copy() if out is None else out * step + part
            have += length
        if have == k:
            return mix(out)
        power = power[:-length] * step + power[length:]
        step = np.uint64(int(step) ** 2 % 2**64)
        length *= 2


class RangeHash:
    """Hashes of word ranges of any length by prefix sums."""

    def __init__(self, h: np.ndarray, base: np.uint64):
        inverse = np.uint64(pow(int(base), -1, 2**64))
        p = powers(base, len(h) + 1)
        self.sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * p[: len(h)], dtype=np.uint64)])
        self.back = powers(inverse, len(h) + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sum[end] - self.sum[start]) * self.back[start] + (end - start).astype(np.uint64))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def table(batch_columns: dict[str, np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(batch_columns[f.name], f.type) for f in schema], schema=schema)
