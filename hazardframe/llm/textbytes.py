"""Vectorised work on UTF-8 texts inside tasks: slices of Arrow batches, tokens and their hashes.

All classes of bytes used here are ASCII, so whole UTF-8 bytes can stand for characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Text bytes that one slice of a batch holds at most, unless a single text is longer.
SLICE_BYTES = 2_000_000


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if bounds[-1] > bounds[0] else np.empty(0, np.uint8)
    return data, bounds - bounds[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, bounds = texts(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, in place."""
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def randoms(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + U64(seed << 32)) * U64(0x9E3779B97F4A7C15)) | U64(1)


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = lower_table()
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
NOT_SPACE = ~_SPACE
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def runs(data: np.ndarray, bounds: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of member bytes; no run crosses a text's bounds."""
    inside = member[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    full = bounds[:-1] < bounds[1:]
    begin, end = bounds[:-1][full], bounds[1:][full] - 1
    first[begin] = inside[begin]
    last[end] = inside[end]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit multilinear hash of each non-overlapping, ordered span of bytes; empty spans hash alike."""
    out = np.zeros(len(starts), np.uint64)
    lengths = ends - starts
    full = np.flatnonzero(lengths > 0)
    if len(full):
        n = lengths[full]
        first = np.cumsum(n) - n
        within = np.arange(first[-1] + n[-1]) - np.repeat(first, n)
        at = within + np.repeat(starts[full], n)
        values = (data[at].astype(np.uint64) + U64(1)) * randoms(int(n.max()), seed)[within]
        out[full] = np.add.reduceat(values, first)
    return mix(out + lengths.astype(np.uint64) * U64(0xD6E8FEB86659FD93))


def gram_hashes(units: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """Hash of each n consecutive units; as many as there are whole grams."""
    m = len(units) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    factors = randoms(n, seed)
    total = units[:m] * factors[0]
    for k in range(1, n):
        total += units[k : k + m] * factors[k]
    return mix(total)


def owner_of(bounds: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Index of the text that each position lies in."""
    return np.searchsorted(bounds[1:], positions, "right")


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each ``width`` consecutive values, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x
