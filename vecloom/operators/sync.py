"""Keeping an index in step with a library: what to add, drop and encode again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions import vector
from vecloom.types import ENCODE_BATCH, FRAGMENT


def usable(index: DataFrame, dimension: int) -> DataFrame:
    return index.where(vector.is_usable(F.col("embedding"), dimension))


def additions(library: DataFrame, index: DataFrame, dimension: int) -> DataFrame:
    """Library ids without a usable vector."""
    return library.select("id").distinct().join(usable(index, dimension).select("id"), "id", "left_anti")


def deletions(library: DataFrame, index: DataFrame, access: str) -> DataFrame:
    """Index ids that the library lacks; only full access may tell that an item is gone."""
    gone = index.select("id").distinct().join(library.select("id"), "id", "left_anti")
    return gone if access == "full" else gone.where(F.lit(False))


def edited(library: DataFrame, versions: DataFrame) -> DataFrame:
    """Ids whose stored and current versions are both known and differ: (id, version) on both sides."""
    old = versions.select("id", F.col("version").alias("known"))
    return library.join(old, "id").where(F.col("version").isNotNull() & F.col("known").isNotNull() & (F.col("version") != F.col("known"))).select("id")


def unchanged(pending: DataFrame, library: DataFrame) -> DataFrame:
    """Pending rows whose version still is the library's (two unknown versions are equal)."""
    now = library.select(F.col("id").alias("__id"), F.col("version").alias("__version"))
    return pending.join(now, (F.col("id") == F.col("__id")) & F.col("version").eqNullSafe(F.col("__version")), "left_semi")


def progress(library: DataFrame, index: DataFrame, dimension: int) -> DataFrame:
    """required, indexed, blank (a row, but not usable), remaining."""
    state = library.select("id").distinct().join(index.select("id", F.lit(True).alias("has"), vector.is_usable(F.col("embedding"), dimension).alias("ok")), "id", "left")
    return state.agg(
        F.count(F.lit(1)).alias("required"),
        F.count_if(F.coalesce("ok", F.lit(False))).alias("indexed"),
        F.count_if(F.coalesce("has", F.lit(False)) & ~F.coalesce("ok", F.lit(False))).alias("blank"),
        F.count_if(~F.coalesce("ok", F.lit(False))).alias("remaining"),
    )


def batch_plan(ids: DataFrame, fragment: int = FRAGMENT, batch: int = ENCODE_BATCH) -> DataFrame:
    """fragment_no, batch_no, items: ids in order, in fragments that split into batches.

    Places come from a range-partitioned sort and the sizes of its partitions, so no task holds all rows.
    """
    from vecloom.operators.ordering import positions

    at = positions(ids.select("id"), ["id"], "at")
    return (
        at.groupBy(F.floor(F.col("at") / fragment).alias("fragment_no"), F.floor(F.col("at") % fragment / batch).alias("batch_no"))
        .agg(F.count(F.lit(1)).alias("items"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    )


def first_final(events: DataFrame, key: list[str], order: str, final: str) -> DataFrame:
    """Of each request the first final answer; partial ones and later ones are dropped."""
    w = Window.partitionBy(*key).orderBy(order)
    return events.where(F.col(final)).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def reconcile(index: DataFrame, library: DataFrame, versions: DataFrame, access: str) -> DataFrame:
    """The index without what was edited or (under full access) is gone."""
    drop = deletions(library, index, access).unionByName(edited(library, versions)).distinct()
    return index.join(drop, "id", "left_anti")
