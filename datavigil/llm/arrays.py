"""Vectorized text helpers for Arrow batches: byte views, word hashes, shingle hashes, ragged gathers.

A batch is worked on in slices of a bounded number of bytes, so that temporaries do not grow with the batch. A single
text longer than that is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C55)  # odd, so that its powers have inverses modulo 2^64
_SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64, on a copy."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, salt: int) -> np.ndarray:
    """n odd 64-bit constants that follow from salt."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) | np.uint64(1)


_BYTE = constants(256, 11)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(_SPACES)] = True
#: White space and ASCII punctuation, for words that punctuation does not change.
PUNCTUATION = _IS_SPACE.copy()
PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; kept up to the slice size, longer ones are made for the one text."""
    size = max(n + 1, SLICE_BYTES + 1)
    if "up" in _powers and len(_powers["up"]) >= size:
        return _powers["up"], _powers["down"]
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    tables = []
    for base in (_BASE, inverse):
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        tables.append(np.multiply.accumulate(steps))
    if size == SLICE_BYTES + 1:
        _powers["up"], _powers["down"] = tables
    return tables[0], tables[1]


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string or binary column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def text_bytes(column: pa.Array) -> int:
    """UTF-8 bytes of a string column."""
    _, offsets = byte_view(column)
    return int(offsets[-1] - offsets[0])


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what a task holds and sends back stays small next to long texts."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most limit bytes, or one row."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), rows)
        yield start, stop
        start = stop


def word_hashes(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words, A-Z lower-cased, and where each text's words begin. A word is a run of bytes that do not
    stand between words; as set here [^\\x20\\x09-\\x0D]+."""
    first = int(offsets[0])
    chars = data[first:int(offsets[-1])]
    bounds = offsets - first
    n = len(chars)
    if n == 0:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = between[chars]
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    starts = np.flatnonzero(~space & (edge[:-1] | np.concatenate(([True], space[:-1]))))
    ends = np.flatnonzero(~space & (edge[1:] | np.concatenate((space[1:], [True])))) + 1
    up, down = _power_tables(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE_LOWER[chars] * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, bounds)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of size words of each text; of fewer words, the whole sequence is one. Not yet distinct."""
    factors = constants(size, 101)
    counts = np.diff(offsets)
    runs = np.maximum(counts - size + 1, 0)
    runs[(counts > 0) & (counts < size)] = 1
    out_offsets = np.concatenate(([0], np.cumsum(runs)))
    out = np.empty(int(out_offsets[-1]), dtype=np.uint64)
    if len(words) >= size:
        whole = words[:len(words) - size + 1] * factors[0]
        for j in range(1, size):
            whole += words[j:len(words) - size + 1 + j] * factors[j]
        whole = mix(whole + np.uint64(size))
        long = np.flatnonzero(counts >= size)
        places = ragged(offsets[long], runs[long])
        targets = ragged(out_offsets[long], runs[long])
        out[targets] = whole[places]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        own = words[offsets[i]:offsets[i + 1]]
        total = (own * factors[:len(own)]).sum(dtype=np.uint64)
        out[out_offsets[i]] = mix(np.array([total + np.uint64(len(own))], dtype=np.uint64))[0]
    return out, out_offsets


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i], starts[i] + 1, ... lengths[i] of them, one after the other."""
    lengths = np.asarray(lengths, dtype=np.int64)
    total = int(lengths.sum())
    if total == 0:
        return np.empty(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(np.asarray(starts, dtype=np.int64) - before, lengths) + np.arange(total)


def distinct_sets(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, and their offsets."""
    parts = [np.unique(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    out = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), out


def binary_array(blob: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary column whose row i is blob[offsets[i]:offsets[i + 1]], offsets in elements of blob."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [
        None, pa.py_buffer((offsets * blob.itemsize).astype(np.int64).tobytes()), pa.py_buffer(np.ascontiguousarray(blob))],
    ).cast(pa.binary())
