"""The accelerated index: unit vectors packed in Float16 blocks, validated once while they are built.

A block is one row (ids, matrix), so a search reads a few large values instead of many arrays, multiplies
each block with all queries in Float32 and sends on its best K of each query. ``upsert`` and ``remove`` make a
new index from the old one's rows: what comes in is validated as a whole before the old one is left, so a bad
row changes nothing, and the old index answers until it is released.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.operators.search import unit_query
from vecloom.runtime import ship
from vecloom.types import DEFAULT_K, LEAST_NORM, EngineError

BLOCK_BYTES = 8 << 20


def matrix(column: pa.Array, dimension: int) -> tuple[np.ndarray | None, str | None, int]:
    """The vectors of a column as one matrix, or the first broken rule and its row: dimension, finiteness, norm."""
    if column.null_count or (len(column) and set(np.unique(column.value_lengths().to_numpy())) != {dimension}):
        sizes = [-1 if n is None else n for n in column.value_lengths().to_pylist()]
        return None, "dimensionMismatch", next(i for i, n in enumerate(sizes) if n != dimension)
    flat = column.flatten()
    v = flat.to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dimension)
    bad = ~np.isfinite(v).all(1)
    if flat.null_count or bad.any():
        return None, "nonFiniteVector", int(bad.argmax())
    norm = np.sqrt(np.einsum("ij,ij->i", v, v, dtype=np.float64))
    if (norm <= LEAST_NORM).any():
        return None, "zeroNormVector", int((norm <= LEAST_NORM).argmax())
    return (v / norm[:, None]).astype(np.float32), None, -1


class PackedIndex:
    def __init__(self, blocks: DataFrame, dimension: int, id_type: str):
        self.blocks, self.dimension, self.id_type = blocks, dimension, id_type

    @classmethod
    def build(cls, rows: DataFrame, dimension: int) -> PackedIndex:
        """Pack and cache (id, embedding). Any invalid row fails the build, before a search can miss it."""
        ship(rows.sparkSession)
        kind = rows.schema["id"].dataType.simpleString()
        most = max(1, BLOCK_BYTES // (2 * dimension))

        def run(batches):
            for b in batches:
                for at in range(0, b.num_rows, most):
                    part = b.slice(at, most)
                    v, error, row = matrix(part.column(1), dimension)
                    ids = part.column(0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids.to_pylist() if error is None else [ids[row].as_py()]], pa.list_(ids.type)), pa.array([None if v is None else v.astype(np.float16).tobytes()], pa.binary()), pa.array([error], pa.string())],
                        names=["ids", "units", "error"],
                    )

        blocks = rows.select("id", "embedding").mapInArrow(run, f"ids array<{kind}>, units binary, error string").cache()
        bad = blocks.agg(F.count("error").alias("n"), F.min(F.when(F.col("error").isNotNull(), F.struct(F.col("ids")[0].alias("id"), "error"))).alias("first")).first()
        if bad["n"]:
            blocks.unpersist()
            raise EngineError(bad["first"]["error"], str(bad["first"]["id"]))
        return cls(blocks, dimension, kind)

    def search(self, queries: dict[str, list[float]], k: int = DEFAULT_K) -> DataFrame:
        """query_id, rank, id, score: the best k of each query by falling score, then id."""
        names, k = list(queries), max(0, k)
        q = np.array([unit_query(queries[n], self.dimension) for n in names], np.float32).astype(np.float16).astype(np.float32)
        dimension = self.dimension

        def run(batches):
            for b in batches:
                for ids, units in zip(b.column(0), b.column(1)):
                    v = np.frombuffer(units.as_buffer(), np.float16).reshape(-1, dimension).astype(np.float32)
                    s = v @ q.T
                    if not np.isfinite(s).all():
                        raise EngineError("nonFiniteResult")
                    name, take = [], []
                    for j in range(len(names) if k else 0):
                        best = np.flatnonzero(s[:, j] >= np.partition(s[:, j], -k)[-k]) if len(s) > k else np.arange(len(s))
                        name.append(np.full(len(best), j))
                        take.append(best)
                    j, i = (np.concatenate(name), np.concatenate(take)) if name else (np.zeros(0, int), np.zeros(0, int))
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(names, object)[j], pa.string()), ids.values.take(pa.array(i)), pa.array(s[i, j], pa.float32())], names=["query_id", "id", "score"])

        scored = self.blocks.select("ids", "units").mapInArrow(run, f"query_id string, id {self.id_type}, score float")
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("long").alias("rank"), "id", "score")

    def _without(self, ids: DataFrame) -> DataFrame:
        """The blocks again, without these ids (unknown ones are ignored)."""
        dimension, most = self.dimension, max(1, BLOCK_BYTES // (2 * self.dimension))

        def open_(batches):
            for b in batches:
                for ids, units in zip(b.column(0), b.column(1)):
                    width = 2 * dimension
                    raw = pa.Array.from_buffers(pa.binary(width), len(ids.values), [None, units.as_buffer()])
                    yield pa.RecordBatch.from_arrays([ids.values, raw.cast(pa.binary())], names=["id", "units"])

        def close(batches):
            for b in batches:
                for a in range(0, b.num_rows, most):
                    part = b.slice(a, most)
                    ids = part.column(0)
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([b"".join(part.column(1).to_pylist())], pa.binary()), pa.array([None], pa.string())], names=["ids", "units", "error"])

        rows = self.blocks.select("ids", "units").mapInArrow(open_, f"id {self.id_type}, units binary")
        return rows.join(ids.select("id"), "id", "left_anti").mapInArrow(close, f"ids array<{self.id_type}>, units binary, error string")

    def upsert(self, rows: DataFrame) -> PackedIndex:
        """The index with (id, embedding) put in or replaced; an id must come once."""
        seen = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids")).first()
        if seen["n"] != seen["ids"]:
            raise EngineError("duplicateID")
        new = PackedIndex.build(rows, self.dimension)
        return PackedIndex(self._without(rows).unionByName(new.blocks).cache(), self.dimension, self.id_type)

    def remove(self, ids: DataFrame) -> PackedIndex:
        """The index without these ids; ids that it lacks are ignored."""
        return PackedIndex(self._without(ids).cache(), self.dimension, self.id_type)

    def release(self) -> None:
        self.blocks.unpersist()
