"""The vector store as an operation log: replay, upsert, delete and compaction as DataFrame logic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replay(log: DataFrame, payload: list[str] = ("embedding",)) -> DataFrame:
    """Live rows of a log (seq, op 'U' or 'D', id, payload): of each id the latest operation, if it is an upsert.

    Within one segment deletes come before upserts: give them seq 2s and upserts 2s + 1. Only ids and
    numbers are summed; the payload is joined to the few columns that survive.
    """
    last = log.groupBy("id").agg(F.max("seq").alias("seq"))
    return log.where(F.col("op") == "U").join(last, ["id", "seq"], "left_semi").select("id", *payload)


def segment_ops(segment: int, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> DataFrame:
    """Log rows of one segment."""
    parts = []
    if deletes is not None:
        parts.append(deletes.select(F.lit(2 * segment).cast("long").alias("seq"), F.lit("D").alias("op"), "id", F.lit(None).cast("array<float>").alias("embedding")))
    if upserts is not None:
        parts.append(upserts.select(F.lit(2 * segment + 1).cast("long").alias("seq"), F.lit("U").alias("op"), "id", "embedding"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def upsert(base: DataFrame, new: DataFrame, payload: str = "embedding") -> DataFrame:
    """Rows of ``base`` with those of ``new`` in place of equal ids."""
    return base.join(new.select("id"), "id", "left_anti").select("id", payload).unionByName(new.select("id", payload))


def delete(base: DataFrame, gone: DataFrame) -> DataFrame:
    """Unknown ids are ignored."""
    return base.join(gone.select("id").distinct(), "id", "left_anti")


def legacy(main: DataFrame, journal: DataFrame, tombstones: DataFrame) -> DataFrame:
    """An old store: main file, then journal (later rows win), then tombstones."""
    return delete(upsert(main, journal), tombstones)
