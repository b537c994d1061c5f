"""Continuous index maintenance: change events in micro-batches into the versioned store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.sources.store import VectorStore


def latest(changes: DataFrame) -> DataFrame:
    """Of each id the last change of a batch: (id, seq, op 'U' or 'D', ...)."""
    w = Window.partitionBy("id").orderBy(F.col("seq").desc())
    return changes.where(F.col("op").isin("U", "D")).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def apply_batch(store: VectorStore, changes: DataFrame, batch_id: int, encode: Callable[[DataFrame], DataFrame]) -> bool:
    """One transaction for one micro-batch; a batch that the manifest already records is skipped."""
    m = store.manifest()
    done = (m or {}).get("checkpoint") or {}
    if done.get("batch_id", -1) >= batch_id:
        return False
    now = latest(changes)
    store.commit(upserts=encode(now.where("op = 'U'")).select("id", "embedding"), deletes=now.where("op = 'D'").select("id"), checkpoint={"batch_id": batch_id}, expect=m["revision"] if m else 0)
    if store.needs_compaction():
        store.compact()
    return True


def run(stream: DataFrame, store: VectorStore, encode: Callable[[DataFrame], DataFrame], checkpoint: str):
    """Start the maintenance query over all changes available now."""
    return (
        stream.writeStream.foreachBatch(lambda df, batch_id: apply_batch(store, df, batch_id, encode))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
