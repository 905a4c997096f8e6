"""Vectorised words, word hashes and shingles of Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one round of array work holds at a time (one longer text is a round alone).
ROUND_BYTES = 512 << 10
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_random = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUE = _random.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * n, _BASE, np.uint64), dtype=np.uint64)])
    return _powers


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, null as empty; offsets start at 0."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def rounds(column: pa.Array, limit: int = ROUND_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, lower-cased bytes, offsets) in parts of about `limit` bytes, whole rows each."""
    raw, offs = text_buffers(column)
    row = 0
    while row < len(offs) - 1:
        end = int(np.searchsorted(offs, offs[row] + limit, "right")) - 1
        end = min(max(end, row + 1), len(offs) - 1)
        part = offs[row : end + 1]
        yield row, end, _LOWER[raw[part[0] : part[-1]]], part - part[0]
        row = end


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word offsets per row): maximal runs of bytes other than 0x20 and 0x09-0x0D."""
    full = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    first, last = full.copy(), full.copy()
    if len(data):
        first[1:] &= ~full[:-1] | edge[1:-1]
        last[:-1] &= ~full[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    inside = np.concatenate([[0], np.cumsum(lengths)])
    place = np.arange(inside[-1]) - np.repeat(inside[:-1], lengths)
    value = _BYTE_VALUE[data[np.repeat(starts, lengths) + place]]
    value *= powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(value, inside[:-1]) + lengths.astype(np.uint64))


def shingle_hashes(words: np.ndarray, woffs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row offsets) of each row's k-word shingles; a shorter row is one shingle of all its words."""
    n = np.diff(woffs)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    soffs = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(woffs[:-1] - soffs[:-1], count) + np.arange(soffs[-1])
    size = np.minimum(np.repeat(n, count), k)
    out = mix(size.astype(np.uint64) * _BASE)
    for j in range(k):
        has = size > j
        if has.all():
            out = mix(out * _MIX2 + words[first + j])
        else:
            out[has] = mix(out[has] * _MIX2 + words[first[has] + j])
    return out, soffs


def slices(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose strings, binaries or list items in one column come to about `limit` each."""
    values = batch.column(column)
    if pa.types.is_list(values.type):
        offs = values.offsets.to_numpy().astype(np.int64)
    else:
        offs = text_buffers(values)[1]
    row = 0
    while row < batch.num_rows:
        end = int(np.searchsorted(offs, offs[row] + limit, "right")) - 1
        end = min(max(end, row + 1), batch.num_rows)
        yield batch.slice(row, end - row)
        row = end
