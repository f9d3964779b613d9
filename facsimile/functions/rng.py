"""Random draws that depend on (seed, tag, row key) only.

``rand``/``randn`` give other values when the partitioning changes, so a retried task or a second
run would not repeat the first.  These draws hash the row key instead: the same seed gives the same
table on any cluster.  A known seed makes the noise predictable; use seeds for tests and leave the
seed unset (``fresh_seed``) for a release.
"""

from __future__ import annotations

import math
import secrets
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fresh_seed() -> int:
    """A random 63-bit seed, drawn once on the driver."""
    return secrets.randbits(63)


def _digest(seed, tag: str, key: tuple) -> Column:
    parts = [F.col(k) if isinstance(k, str) else k for k in key]
    return F.md5(F.concat_ws("|", F.lit(f"{seed}|{tag}"), *[p.cast("string") for p in parts]))


def _unit(digest: Column, start: int) -> Column:
    # 13 hex digits = 52 bits, centred in their cell: strictly inside (0, 1)
    return (F.conv(F.substring(digest, start, 13), 16, 10).cast("double") + 0.5) / float(2**52)


class Draws:
    """The draws of many tags for one row key, taken together: pass it to the functions below in place of the seed.

    Expressions refer to an array column that ``over`` adds to the rows.  One Arrow function hashes the key of
    a block of rows with every tag.  Written out as text conversions in one projection, the draws
    of a dozen columns are a method too long to be compiled.
    """

    def __init__(self, seed, column: str = "_draws"):
        self.seed, self.column, self.uniforms, self.normals, self.key = seed, column, {}, {}, None

    def place(self, wanted: dict[str, int], tag: str, key: tuple) -> Column:
        if self.key not in (None, key):
            raise ValueError("draws taken together share one row key")
        self.key = key
        held = f"{self.column}_{'u' if wanted is self.uniforms else 'z'}"
        return F.get(F.col(held), F.lit(wanted.setdefault(tag, len(wanted))))

    def over(self, df: DataFrame) -> DataFrame:
        """``df`` with all draws asked for so far, as arrays."""
        if self.key is None:
            return df
        parts = [F.col(k) if isinstance(k, str) else k for k in self.key]
        # the empty part leads with the separator; what is null is left out, as in a single draw
        tail = F.concat_ws("|", F.lit(""), *[p.cast("string") for p in parts])
        read = _read_units(*[[f"{self.seed}|{tag}" for tag in tags] for tags in (self.uniforms, self.normals)])
        halves = df.withColumn(self.column, read(tail))
        return halves.withColumns({
            f"{self.column}_u": F.col(self.column)["u"],
            f"{self.column}_z": F.zip_with(F.col(self.column)["a"], F.col(self.column)["b"], _box_muller),
        })


def _read_units(uniforms: list[str], normals: list[str]):
    """Arrow function from the rest of a message to the first halves of its digests with each lead of ``uniforms``
    (``u``), and both halves with each lead of ``normals`` (``a``, ``b``), as arrays."""

    @F.arrow_udf("u array<double>, a array<double>, b array<double>")
    def read(tails: pa.Array) -> pa.Array:
        offsets = np.frombuffer(tails.buffers()[1], np.int32, len(tails) + 1, 4 * tails.offset).astype(np.int64) \
            if len(tails) else np.zeros(1, np.int64)
        text, lengths = np.frombuffer(tails.buffers()[2] or b"", np.uint8), np.diff(offsets)
        units = [np.empty((len(tails), len(leads))) for leads in (uniforms, normals, normals)]
        for length in np.unique(lengths):
            rows = np.flatnonzero(lengths == length)
            tail = text[offsets[rows, None] + np.arange(length)]
            for of, lead in enumerate([*uniforms, *normals]):
                start = np.frombuffer(lead.encode(), np.uint8)
                first, second = digest_units(np.hstack([np.broadcast_to(start, (len(rows), len(start))), tail]))
                if of < len(uniforms):
                    units[0][rows, of] = first
                else:
                    units[1][rows, of - len(uniforms)], units[2][rows, of - len(uniforms)] = first, second
        ends = lambda part: pa.array(np.arange(len(tails) + 1, dtype=np.int32) * np.int32(part.shape[1]))
        arrays = [pa.ListArray.from_arrays(ends(part), pa.array(part.ravel())) for part in units]
        return pa.StructArray.from_arrays(arrays, names=["u", "a", "b"])

    return read


# the constants of MD5: rotations and sines by step
_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]


def digest_units(messages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the second 52 bits of the MD5 of each row of bytes, as numbers in (0, 1)."""
    rows, size = messages.shape
    blocks = (size + 8) // 64 + 1
    padded = np.zeros((rows, 64 * blocks), np.uint8)
    padded[:, :size], padded[:, size] = messages, 0x80
    padded[:, -8:] = np.frombuffer(struct.pack("<Q", 8 * size), np.uint8)
    words = np.ascontiguousarray(padded.view("<u4").T)
    state = [np.full(rows, v, np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    for block in range(0, 16 * blocks, 16):
        a, b, c, d = state
        for i in range(64):
            if i < 16:
                mixed, word = d ^ (b & (c ^ d)), i
            elif i < 32:
                mixed, word = c ^ (d & (b ^ c)), (5 * i + 1) % 16
            elif i < 48:
                mixed, word = b ^ c ^ d, (3 * i + 5) % 16
            else:
                mixed, word = c ^ (b | ~d), 7 * i % 16
            mixed += a
            mixed += words[block + word]
            mixed += _SINES[i]
            turned = mixed << np.uint32(_TURNS[i])
            turned |= mixed >> np.uint32(32 - _TURNS[i])
            turned += b
            a, b, c, d = d, turned, b, c
        state = [x + y for x, y in zip(state, (a, b, c, d))]
    first, second, third, fourth = (w.byteswap().astype(np.uint64) for w in state)
    high, low = (first << 32) | second, (third << 32) | fourth
    unit = lambda bits: (bits.astype(np.float64) + 0.5) / 2.0**52
    return unit(high >> 12), unit(((high & 0xFFF) << 40) | (low >> 24))


def _box_muller(first: Column, second: Column) -> Column:
    return F.sqrt(F.lit(-2.0) * F.ln(first)) * F.cos(F.lit(2.0 * math.pi) * second)


def uniform(seed, tag: str, *key) -> Column:
    """A uniform draw in (0, 1) for each row key."""
    return seed.place(seed.uniforms, tag, key) if isinstance(seed, Draws) else _unit(_digest(seed, tag, key), 1)


def normal(seed, tag: str, *key) -> Column:
    """A standard normal draw for each row key (Box-Muller over both halves of one digest)."""
    if isinstance(seed, Draws):
        return seed.place(seed.normals, tag, key)
    digest = _digest(seed, tag, key)
    return _box_muller(_unit(digest, 1), _unit(digest, 14))


def laplace(scale, seed, tag: str, *key) -> Column:
    """A zero-centred Laplace draw of the given scale for each row key (inverse CDF)."""
    centred = uniform(seed, tag, *key) - F.lit(0.5)
    return F.lit(-1.0) * F.lit(scale) * F.signum(centred) * F.ln(1 - 2 * F.abs(centred))
