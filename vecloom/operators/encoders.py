"""Pluggable encoders: batches first, single items where a batch fails, failures kept for a retry."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vecloom.runtime import ship
from vecloom.types import ENCODE_BATCH, LEAST_NORM

Encoder = Callable[[list[str]], list[np.ndarray]]


def digest_encoder(dimension: int) -> Encoder:
    """A deterministic stand-in for a model: signs from digests of the words, so equal texts have equal vectors."""

    def one(text: str) -> np.ndarray:
        v = np.zeros(dimension, np.float32)
        for w in text.split() or [""]:
            bits = np.unpackbits(np.frombuffer(hashlib.shake_128(w.encode()).digest(-(-dimension // 8)), np.uint8))[:dimension]
            v += bits.astype(np.float32) * 2 - 1
        return v

    return lambda texts: [one(t) for t in texts]


def acceptable(v, dimension: int) -> bool:
    v = np.asarray(v)
    return v.shape in ((dimension,), (1, dimension)) and bool(np.isfinite(v).all()) and float(np.sqrt((v.astype(np.float64) ** 2).sum())) > LEAST_NORM


def encode_batch(items: list[str], encoder: Encoder, dimension: int) -> list[np.ndarray | None]:
    """One result per item. A batch that raises or has the wrong number of outputs is encoded one by one; an invalid member of a good batch just fails."""
    try:
        out = encoder(items)
        if len(out) != len(items):
            raise ValueError("wrong number of outputs")
    except Exception:  # noqa: BLE001 - any failure of a model means one by one
        out = []
        for item in items:
            try:
                out.append(encoder([item])[0])
            except Exception:  # noqa: BLE001
                out.append(None)
    return [np.asarray(v, np.float32).reshape(-1) if v is not None and acceptable(v, dimension) else None for v in out]


def encode(rows: DataFrame, make_encoder: Callable[[], Encoder], dimension: int, id_col: str = "id", item_col: str = "item", batch: int = ENCODE_BATCH) -> DataFrame:
    """id, embedding, failed: the encoder is made once for each task; failed items keep a null vector for the retry."""
    ship(rows.sparkSession)
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        encoder = make_encoder()
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                got = encode_batch([t or "" for t in part.column(1).to_pylist()], encoder, dimension)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if v is None else v.tolist() for v in got], pa.list_(pa.float32())), pa.array([v is None for v in got], pa.bool_())], names=[id_col, "embedding", "failed"])

    return rows.select(id_col, item_col).mapInArrow(run, f"`{id_col}` {kind}, embedding array<float>, failed boolean")
