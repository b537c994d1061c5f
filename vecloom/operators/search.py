"""Exact top-K retrieval over a published vector index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions import vector
from vecloom.runtime import ship
from vecloom.types import DEFAULT_K, EngineError

LARGEST_BROADCAST = 10_000
ROW_BLOCK, QUERY_BLOCK = 16_384, 1024


def validation_report(index: DataFrame, dimension: int, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """Rows that break a rule: id, error."""
    return index.select(F.col(id_col).alias("id"), vector.error_name(F.col(vec_col), dimension).alias("error")).where("error IS NOT NULL")


class VectorIndex:
    """An index that was validated as a whole: one invalid row fails every search (no partial results)."""

    def __init__(self, rows: DataFrame, dimension: int, identity: str | None = None):
        self.rows, self.dimension, self.identity = rows, dimension, identity
        self.known: dict = {}

    @classmethod
    def publish(cls, rows: DataFrame, dimension: int, identity: str | None = None, item=None) -> VectorIndex:
        """``rows``: (id, embedding). The check is one aggregate over all rows, before any filter can hide one; it
        also fetches the vector of ``item``, if one is named."""
        mine = F.coalesce(F.col("id") == F.lit(item), F.lit(False)) if item is not None else F.lit(False)
        checked = rows.select("id", vector.error_name(F.col("embedding"), dimension).alias("error"), F.when(mine, F.col("embedding")).alias("mine"))
        bad = F.col("error").isNotNull()
        found = checked.agg(F.count_if(bad).alias("n"), F.min(F.when(bad, F.struct("id", "error"))).alias("first"), F.first("mine", ignorenulls=True).alias("mine")).first()
        if found["n"]:
            raise EngineError(found["first"]["error"], f"{found['n']} rows, the first {found['first']['id']}")
        index = cls(rows, dimension, identity)
        if found["mine"] is not None:
            index.known[item] = list(found["mine"])
        return index

    def require(self, identity: str | None) -> None:
        if self.identity is not None and identity is not None and identity != self.identity:
            raise EngineError("modelIdentityMismatch")

    def vector_of(self, item) -> list[float]:
        if item in self.known:
            return self.known[item]
        found = self.rows.where(F.col("id") == F.lit(item)).select("embedding").limit(2).collect()
        if not found:
            raise EngineError("referencePhotoMissing", str(item))
        return list(found[0][0])


def unit_query(query: list[float], dimension: int) -> list[float]:
    """Float64 components at length 1; an invalid query raises, also over an empty index."""
    if len(query) != dimension:
        raise EngineError("dimensionMismatch", f"{len(query)} for {dimension}")
    norm = 0.0
    for x in query:
        if not np.isfinite(x):
            raise EngineError("nonFiniteVector")
        norm += float(np.float32(x)) ** 2
    norm = norm**0.5
    if norm <= 1e-8:
        raise EngineError("zeroNormVector")
    return [float(np.float32(x)) / norm for x in query]


def visible_only(scored: DataFrame, visible: DataFrame | None) -> DataFrame:
    """Rows whose id is in ``visible`` (all rows if there is no such snapshot)."""
    return scored if visible is None else scored.join(visible.select("id"), "id", "left_semi")


def top(scored: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """rank, id, score: the best k by falling score, then id. A negative k is none."""
    best = scored.orderBy(F.col("score").desc(), F.col("id")).limit(max(0, k))
    return best.select(F.row_number().over(Window.orderBy(F.col("score").desc(), F.col("id"))).cast("long").alias("rank"), "id", "score")


def score(index: VectorIndex, query: list[float]) -> DataFrame:
    """id, score by expressions only; the query is one literal array."""
    q = unit_query(query, index.dimension)
    return index.rows.select("id", vector.cosine_to_unit(F.col("embedding"), F.array(*[F.lit(x) for x in q])).alias("score"))


def score_half(index: VectorIndex, query: list[float]) -> DataFrame:
    """id, score by Float16 codes and Float32 products, a block of rows at a time; not clamped."""
    ship(index.rows.sparkSession)
    q = np.array(unit_query(query, index.dimension), np.float32).astype(np.float16).astype(np.float32)
    kind = index.rows.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)
            v /= np.sqrt((v * v).sum(1, keepdims=True))
            scores = v.astype(np.float32).astype(np.float16).astype(np.float32) @ q
            if not np.isfinite(scores).all():
                raise EngineError("nonFiniteResult")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float32())], names=["id", "score"])

    return index.rows.select("id", "embedding").mapInArrow(run, f"id {kind}, score float")


def score_blocks(index: VectorIndex, queries: dict, k: int) -> DataFrame:
    """query_id, id, score: for each query the best k of every block of rows (exact; Float64 products). The caller keeps the best of them."""
    ship(index.rows.sparkSession)
    names = list(queries)
    q = np.array([unit_query(queries[n], index.dimension) for n in names], np.float64)
    kind = index.rows.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)
            s = np.clip((v / np.sqrt((v * v).sum(1, keepdims=True))) @ q.T, -1, 1).astype(np.float32)
            for j, name in enumerate(names):
                if len(s) > k:  # all rows that tie with the k-th stay
                    take = np.flatnonzero(s[:, j] >= np.partition(s[:, j], -k)[-k])
                else:
                    take = np.arange(len(s))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(take), pa.string()), b.column(0).take(pa.array(take)), pa.array(s[take, j], pa.float32())], names=["query_id", "id", "score"])

    return index.rows.select("id", "embedding").mapInArrow(run, f"query_id string, id {kind}, score float")


def search(index: VectorIndex, query: list[float], k: int = DEFAULT_K, visible: DataFrame | None = None, backend: str = "sql", scorer=score_half) -> DataFrame:
    """Top K by one vector. backend 'arrow' falls back to expressions if its scorer says it is not available."""
    if backend == "arrow":
        try:
            scored = scorer(index, query)
        except EngineError as e:
            if e.code not in ("indexUnavailable", "resultsUnavailable"):
                raise
            scored = score(index, query)
    else:
        scored = score(index, query)
    return top(visible_only(scored, visible), k)


def similar(index: VectorIndex, item, k: int = DEFAULT_K, visible: DataFrame | None = None, backend: str = "sql") -> DataFrame:
    """Top K by an item of the index; the item itself is among the results."""
    return search(index, index.vector_of(item), k, visible, backend)


def unit_blocks(rows: DataFrame, dimension: int, most: int) -> DataFrame:
    """ids, units: rows of valid vectors packed into blocks of at most ``most``, in double precision at length 1."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, most):
                part = b.slice(a, most)
                v = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension).astype(np.float64)
                v /= np.sqrt((v * v).sum(1, keepdims=True))
                ids = part.column(0)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([v.tobytes()], pa.binary())], names=["ids", "units"])

    return rows.select("id", "embedding").mapInArrow(run, f"ids array<{kind}>, units binary")


def batch_top(index: DataFrame, queries: DataFrame, k: int, dimension: int) -> DataFrame:
    """query_id, rank, id, score for many queries: (query_id, embedding).

    Both sides are validated as a whole. Every vector is scaled once; blocks of rows meet blocks of queries, and a
    pair of blocks sends on only its best k (and ties) of each query. Queries are broadcast up to a checked number.
    """
    ship(index.sparkSession)
    asked = queries.select(F.col("query_id").alias("id"), "embedding")
    for side in (index, asked):
        VectorIndex.publish(side, dimension)
    k = max(0, k)
    few = asked.limit(LARGEST_BROADCAST + 1).count() <= LARGEST_BROADCAST
    q = unit_blocks(asked.coalesce(1) if few else asked, dimension, QUERY_BLOCK).select(F.col("ids").alias("names"), F.col("units").alias("asked"))
    pairs = unit_blocks(index, dimension, ROW_BLOCK).crossJoin(F.broadcast(q) if few else q)
    kinds = asked.schema["id"].dataType.simpleString(), index.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for ids, units, names, against in zip(*b.columns):
                if not k:
                    continue
                v, w = (np.frombuffer(x.as_buffer(), np.float64).reshape(-1, dimension) for x in (units, against))
                s = np.clip(v @ w.T, -1, 1).astype(np.float32)
                least = np.partition(s, -k, axis=0)[-k] if len(s) > k else np.full(s.shape[1], -np.inf)
                i, j = np.nonzero(s >= least)
                yield pa.RecordBatch.from_arrays([names.values.take(pa.array(j)), ids.values.take(pa.array(i)), pa.array(s[i, j])], names=["query_id", "id", "score"])

    scored = pairs.mapInArrow(run, f"query_id {kinds[0]}, id {kinds[1]}, score float")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("long").alias("rank"), "id", "score")


def status(index: DataFrame, results: DataFrame | None, failed: bool = False) -> str:
    """The state that a search ends in."""
    if index.isEmpty():
        return "NEVER_INDEXED"
    if failed:
        return "SEARCH_ERROR"
    return "NO_RESULT" if results is None or results.isEmpty() else "HAS_RESULT"


def item_query(rows: DataFrame, item, dimension: int, k: int = DEFAULT_K, visible: DataFrame | None = None) -> DataFrame:
    """``similar`` over rows that are not published yet: one aggregate validates all of them and fetches the item's vector."""
    return similar(VectorIndex.publish(rows.select("id", "embedding"), dimension, item=item), item, k, visible)
