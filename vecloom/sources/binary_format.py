"""The binary segment format (version 2): little-endian header and records, Float16 or Float32."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np

from vecloom.types import EngineError

MAGIC, VERSION, MOST_METADATA = b"QEMB", 2, 65536


def header(count: int, metadata: bytes) -> bytes:
    """Magic, version (uint32), records (uint64), length of the metadata (uint32), metadata."""
    if len(metadata) > MOST_METADATA:
        raise EngineError("invalidMetadata")
    return MAGIC + struct.pack("<IQI", VERSION, count, len(metadata)) + metadata


def scalars(vector: np.ndarray, storage: str = "float32", normalise: bool = False) -> np.ndarray:
    """Components as stored. Norms at or below 1e-8 stay as they are; overflow is an error, not clamped."""
    v = np.asarray(vector, np.float64)
    if not np.isfinite(v).all():
        raise EngineError("nonFiniteVector")
    norm = float(np.sqrt((v * v).sum()))
    if normalise and norm > 1e-8:
        v = v / norm
    v = v.astype("<f4")
    if storage == "float16":
        with np.errstate(over="ignore"):
            v = v.astype("<f2")
    if not np.isfinite(v).all():
        raise EngineError("scalarOverflow")
    return v


def valid_id(item: str) -> bool:
    return 0 < len(item.encode()) <= 65535 and not any(c in item for c in "\n\r\x0b\x0c\x85  ")


def record(item: str, vector: np.ndarray, storage: str = "float32", normalise: bool = False) -> bytes:
    """Length of the id (uint16), id, components."""
    if not valid_id(item):
        raise EngineError("invalidID", repr(item[:40]))
    raw = item.encode()
    return struct.pack("<H", len(raw)) + raw + scalars(vector, storage, normalise).tobytes()


def write(rows: Iterable[tuple[str, np.ndarray]], metadata: bytes, storage: str = "float32", normalise: bool = False) -> bytes:
    body = [record(i, v, storage, normalise) for i, v in sorted(rows, key=lambda r: r[0])]
    return header(len(body), metadata) + b"".join(body)


def read(data: bytes, dimension: int, storage: str = "float32", metadata: bytes | None = None) -> Iterator[tuple[str, np.ndarray]]:
    """All records; anything that does not add up is corrupt, another contract's metadata incompatible."""
    if len(data) < 20 or data[:4] != MAGIC:
        raise EngineError("corrupt", "header")
    version, count, size = struct.unpack_from("<IQI", data, 4)
    if version != VERSION or size > MOST_METADATA or len(data) < 20 + size:
        raise EngineError("corrupt", "header")
    if metadata is not None and data[20 : 20 + size] != metadata:
        raise EngineError("incompatible")
    at, kind = 20 + size, np.dtype("<f4" if storage == "float32" else "<f2")
    for _ in range(count):
        if at + 2 > len(data):
            raise EngineError("corrupt", "record")
        (n,) = struct.unpack_from("<H", data, at)
        end = at + 2 + n + dimension * kind.itemsize
        if not n or end > len(data):
            raise EngineError("corrupt", "record")
        try:
            item = data[at + 2 : at + 2 + n].decode()
        except UnicodeDecodeError:
            raise EngineError("corrupt", "id") from None
        v = np.frombuffer(data, kind, dimension, at + 2 + n).astype(np.float32)
        if not np.isfinite(v).all():
            raise EngineError("corrupt", "component")
        yield item, v
        at = end
    if at != len(data):
        raise EngineError("corrupt", "trailing bytes")
