"""Vectorised pieces that several operators share: Arrow batches, word hashes, code points."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: An odd multiplier and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base & (1 << 64) - 1, U)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if len(have) <= 1 << 20:
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD1B54A32D192ED03))
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True


def groups(sizes, most_bytes: int = 2 << 20, most_rows: int = 512) -> Iterator[tuple[int, int]]:
    """Runs of rows [a, b) of bounded total size; a longer row is a run of its own."""
    a = total = 0
    for i, n in enumerate(sizes):
        if i > a and (total + n > most_bytes or i - a >= most_rows):
            yield a, i
            a, total = i, 0
        total += n
    if len(sizes) > a:
        yield a, len(sizes)


def words(raw: bytes | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each maximal run of ASCII letters, digits, _ or non-ASCII bytes."""
    buf = np.frombuffer(raw, np.uint8) if isinstance(raw, bytes) else raw
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = WORD_BYTE[buf]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    sums = np.zeros(len(buf) + 1, U)
    np.cumsum(BYTE[buf] * powers(BASE, len(buf)), out=sums[1:])
    return start, end, mix((sums[end] - sums[start]) * powers(INVERSE, len(buf) + 1)[start])


def slices(b: pa.RecordBatch, column: str | int, most_bytes: int = 1 << 18, most_rows: int = 512) -> Iterator[pa.RecordBatch]:
    """A batch in parts of bounded text; what they took is given back to the system now and then."""
    sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_pylist()
    for k, (a, z) in enumerate(groups(sizes, most_bytes, most_rows)):
        yield b.slice(a, z - a)
        if k % 32 == 31:
            release()
    release()


_LIBC: list = []


def release() -> None:
    """Give freed memory back: workers are kept for later tasks, and so would be the most they ever used."""
    if not _LIBC:
        try:
            _LIBC.append(ctypes.CDLL("libc.so.6").malloc_trim)
        except (OSError, AttributeError):  # another C library
            _LIBC.append(lambda _: 0)
    _LIBC[0](0)
    pa.default_memory_pool().release_unused()


def fresh(docs, name: str) -> str:
    """A column name that ``docs`` lacks (Spark does not tell upper from lower case)."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def strings(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Texts of a column; null becomes the empty text."""
    return [x or "" for x in column.to_pylist()]


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)
