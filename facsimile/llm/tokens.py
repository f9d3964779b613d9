"""Words and their 64-bit hashes straight from the bytes of an Arrow batch, without a Python object for each word.

A word's hash is sum(table[byte] * base**position) modulo 2**64 with a random table and an odd base, taken from
running sums, shifted back to position 0 by the inverse power, then mixed.  Tables are drawn from fixed
seeds, so that every task and every run agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

ROWS_BYTES = 1 << 20  # bytes of text handled at once; a longer text is handled alone
BLOCK = 1 << 20  # bytes hashed at once; a longer word is hashed alone

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: What the words are made of: everything but the six ASCII blanks, or letters and all bytes beyond ASCII.
NOT_BLANK = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
LETTERS = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])


def byte_table(seed: int, lower: bool) -> np.ndarray:
    """256 random 64-bit values; with ``lower`` A-Z share those of a-z."""
    table = np.random.default_rng(seed).integers(1, 2**64 - 1, 256, dtype=np.uint64)
    if lower:
        table[65:91] = table[97:123]
    return table


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i below n at least; those of a usual block are kept."""
    size = max(BLOCK + 1024, n)
    if size in _powers:
        return _powers[size]
    up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    made = np.multiply.accumulate(up), np.multiply.accumulate(down)
    if size == BLOCK + 1024:
        _powers[size] = made
    return made


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary or string array; a null is empty."""
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def portions(batches: Iterator[pa.RecordBatch], text: str, most_rows: int = 1 << 30) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about ROWS_BYTES of ``text`` each: (slice, bytes, offsets)."""
    for batch in batches:
        data, at = buffers(batch.column(batch.schema.get_field_index(text)))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(at, at[low] + ROWS_BYTES, "right")) - 1)
            high = min(high, batch.num_rows, low + most_rows)
            yield batch.slice(low, high - low), data[at[low] : at[high]], at[low : high + 1] - at[low]
            low = high


def word_bounds(data: np.ndarray, at: np.ndarray, within: np.ndarray = NOT_BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte bounds of all words, and the number of the first word of each row (and one past the last)."""
    if len(data) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(at), np.int64)
    inside = within[data]
    fresh = np.ones(len(data) + 1, bool)
    np.logical_not(inside[:-1], out=fresh[1:-1])
    fresh[at[at < len(data)]] = True
    starts = np.flatnonzero(inside & fresh[:-1])
    last = np.ones(len(data), bool)
    np.logical_not(inside[1:], out=last[:-1])
    bounds = at[(at > 0) & (at <= len(data))] - 1
    last[bounds] = True
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(starts, at)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray, prefixes: tuple[int, ...] = ()) -> list[np.ndarray]:
    """Hashes of the words, then of their first ``k`` bytes for each k of ``prefixes``."""
    out = [np.empty(len(starts), np.uint64) for _ in range(1 + len(prefixes))]
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + BLOCK, "right")))
        first, stop = starts[low], ends[high - 1]
        up, down = powers(int(stop - first) + 1)
        sums = np.zeros(stop - first + 1, np.uint64)
        np.cumsum(table[data[first:stop]] * up[: stop - first], out=sums[1:])
        s, e = starts[low:high] - first, ends[low:high] - first
        for k, values in enumerate(out):
            to = e if k == 0 else np.minimum(e, s + prefixes[k - 1])
            values[low:high] = mixed((sums[to] - sums[s]) * down[s] + (to - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        low = high
    return out


def runs_hashed(words: np.ndarray, width: int, seed: int) -> np.ndarray:
    """The hash of each run of ``width`` consecutive words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    factors = np.random.default_rng(seed).integers(1, 2**64 - 1, width, dtype=np.uint64) | np.uint64(1)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += words[k : k + n] * factors[k]
    return mixed(total)
