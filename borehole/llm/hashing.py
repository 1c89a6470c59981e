"""Vectorised words, hashes and sliding minima over Arrow batches of texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 2 << 20
BLOCK_BYTES = 1 << 20

#: Separators of words: space and the control characters 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE = np.random.default_rng(20260101).integers(1, 2**63, 256, dtype=np.int64).astype(U64)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit numbers."""
    x = x * U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(29)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(32)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(29)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        have = np.full(size, base, U64)
        have[0] = 1
        have = np.cumprod(have)
        if size <= 4 * BLOCK_BYTES:
            _POWERS[base] = have
    return have[:n]


@dataclass
class Chunk:
    """Some whole documents: ids, their byte ranges, and the bytes of all."""

    ids: np.ndarray
    bounds: np.ndarray
    data: np.ndarray
    rows: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary array; nulls are empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    if column.null_count:
        empty = b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else ""
        column = column.fill_null(empty)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at, raw


def chunks(
    batches: Iterable[pa.RecordBatch], id_column: int = 0, text_column: int = 1, size: int = CHUNK_BYTES
) -> Iterator[Chunk]:
    """Whole documents in groups of about ``size`` bytes, one long document alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(id_column).to_numpy(zero_copy_only=False)
        at, raw = text_buffers(batch.column(text_column))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(at, at[first] + size, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            lo, hi = at[first], at[last]
            yield Chunk(ids[first:last], at[first : last + 1] - lo, raw[lo:hi], np.arange(first, last))
            first = last


def word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; no word crosses a document's end."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~SPACE[data]
    before = np.empty(len(data), bool)
    before[0] = True
    np.logical_not(inside[:-1], out=before[1:])
    edges = bounds[bounds < len(data)]
    before[edges] = True
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = ~inside[1:]
    after[edges[edges > 0] - 1] = True
    return np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, by prefix sums over blocks cut between words."""
    out = np.empty(len(starts), U64)
    first = 0
    while first < len(starts):
        base = starts[first]
        last = max(int(np.searchsorted(ends, base + BLOCK_BYTES, "right")), first + 1)
        block = _BYTE[data[base : ends[last - 1]]]
        block *= _powers(_BASE, len(block))
        sums = np.empty(len(block) + 1, U64)
        sums[0] = 0
        np.cumsum(block, out=sums[1:])
        s, e = starts[first:last] - base, ends[first:last] - base
        out[first:last] = (sums[e] - sums[s]) * _powers(_INVERSE, len(block) + 1)[s]
        out[first:last] += (e - s).astype(U64) * U64(0xD6E8FEB86659FD93)
        first = last
    return mix(out)


def grams(units: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` units."""
    n = len(units) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = units[:n].copy()
    for i in range(1, k):
        out *= U64(0xD1342543DE82EF95)
        out += units[i : i + n]
    return mix(out)


def byte_grams(data: np.ndarray) -> np.ndarray:
    """Hashes of all runs of 16 bytes."""
    n = len(data) - 15
    if n <= 0:
        return np.zeros(0, U64)
    raw = np.ascontiguousarray(data)
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    out = mix(eight[8 : 8 + n].astype(U64))
    out ^= eight[:n]
    return mix(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours."""
    if len(values) < width:
        return values[:0]
    have, m = 1, values
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < width:
        n = len(values) - width + 1
        m = np.minimum(m[:n], m[width - have : width - have + n])
    return m


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
