"""Vectorised text work on Arrow batches: byte views, word spans, word hashes.

A text column is looked at as one NumPy byte array plus offsets. Words are found
with a 256-entry separator table. Words of up to 16 bytes are mixed to 128 bits from their bytes, longer
ones hashed by a seeded XXH3 of 128 bits, so there is no Python loop over characters or most words.
Windows of bytes (`window_hashes`) have a polynomial hash modulo 2**64: it serves to
choose candidates only, since equal hashes do not prove equal bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits (a bijection)."""
    return _mix_in_place(x.astype(np.uint64, copy=True))


def _mix_in_place(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random 64-bit value for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
#: Bytes with A-Z as a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SEED = 0x7374726E64666C77
_SEEDS = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
#: Masks of the first 0 to 8 of eight bytes.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)

#: Bytes that separate words: ASCII white space, or everything ASCII but letters and digits.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_WORD = np.zeros(256, dtype=bool)
NOT_WORD[:128] = True
NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and int64 offsets (nulls: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each hold at most about `max_bytes` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends and row number of every word, in order; words never cross rows."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = ~separators[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts] = False
    after[cuts - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def prefix_sums(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * _power("base", _BASE, len(data)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-independent hash of bytes [start, end), spread by `mix`."""
    inverse = _power("inverse", _INVERSE, len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def window_hashes(sums: np.ndarray, size: int) -> np.ndarray:
    """`span_hashes` of every window of `size` bytes."""
    x = sums[size:] - sums[:-size]
    x *= _power("inverse", _INVERSE, len(sums))[: len(x)]
    x += np.uint64(size)
    return _mix_in_place(x)


def word_lanes(column: pa.Array, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both halves of the 128-bit hash (A-Z as a-z) of every word of a text column, and its row."""
    data, offsets = text_bytes(column)
    starts, ends, rows = words(data, offsets, separators)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), rows
    padded = np.concatenate([LOWER[data], np.zeros(16, np.uint8)])
    eight = np.ndarray((len(data) + 8,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    size = (ends - starts).astype(np.uint64)
    one = eight[starts] & _FIRST[np.minimum(size, 8)]
    two = eight[np.minimum(starts + 8, len(data) + 7)] & _FIRST[np.minimum(np.maximum(size, 8) - 8, 8)]
    first = mix(one ^ mix(two + size * _SEEDS[0]))
    second = mix(two ^ mix(one + size * _SEEDS[1]))
    long = np.flatnonzero(size > 16)
    if len(long):
        whole, digest = padded.tobytes(), xxhash.xxh3_128_digest
        found = b"".join([digest(whole[a:b], _SEED) for a, b in zip(starts[long].tolist(), ends[long].tolist())])
        lanes = np.frombuffer(found, np.uint64).reshape(-1, 2)
        first[long], second[long] = lanes[:, 0], lanes[:, 1]
    return first, second, rows


def word_hashes(column: pa.Array, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash (A-Z as a-z) and row number of every word of a text column."""
    first, _, rows = word_lanes(column, separators)
    return first, rows


def row_starts(rows: np.ndarray, n: int) -> np.ndarray:
    """Where each row's items begin in an array sorted by row; n + 1 entries."""
    return np.searchsorted(rows, np.arange(n + 1))


def combine(*hashes: np.ndarray) -> np.ndarray:
    """Order-dependent hash of aligned hash arrays."""
    out = hashes[0]
    for i, h in enumerate(hashes[1:], 1):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h + np.uint64(i)
    return mix(out)
