"""The library's own changes, and the policies that decide where and when its items are encoded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.types import FRAGMENT, EngineError

#: Device families and the first generation of each whose accelerator may encode text.
FAMILIES, FIRST_ACCELERATED = ("iPhone", "iPad"), 12
#: Heat states that pause indexing, and the number of items after which it rests.
HOT_STATES, REST_EVERY = ("serious", "critical"), 500


def _last(changes: DataFrame, op: str, *key: str) -> DataFrame:
    return changes.where(F.col("op") == op).groupBy(*key).agg(F.max("seq").alias(f"__{op}"))


def members(existing: DataFrame, albums: DataFrame, changes: DataFrame) -> DataFrame:
    """(album, id) after ``changes`` (seq, op, album, id), from the ``existing`` members and the known ``albums``.

    Ops: ``create`` an album, ``add`` and ``remove`` an item, ``removeAll`` items of an album, ``delete`` an item
    from all albums. The last change decides. Null ops, albums or ids (where the op needs them) change nothing.
    A change of an album that is neither known nor created fails the whole call as ``missingAssetCollection``.
    Each kind of change is reduced to its last one before the join, so a busy album is one row.
    """
    known = albums.select("album").unionByName(changes.where("op = 'create'").select("album")).distinct()
    asked = changes.where("op IN ('add', 'remove', 'removeAll') AND album IS NOT NULL")
    if (lost := asked.join(known, "album", "left_anti").select("album").first()) is not None:
        raise EngineError("missingAssetCollection", lost["album"])
    before = existing.where("album IS NOT NULL AND id IS NOT NULL").select(F.lit(-1).cast("long").alias("seq"), "album", "id")
    added = before.unionByName(changes.where("op = 'add' AND album IS NOT NULL AND id IS NOT NULL").select("seq", "album", "id"))
    state = added.groupBy("album", "id").agg(F.max("seq").alias("__add"))
    state = state.join(_last(changes, "remove", "album", "id"), ["album", "id"], "left")
    state = state.join(_last(changes, "removeAll", "album"), "album", "left").join(_last(changes, "delete", "id"), "id", "left")
    gone = F.greatest("__remove", "__removeAll", "__delete")
    return state.where(gone.isNull() | (F.col("__add") > gone)).select("album", "id")


def favourites(items: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, favourite) of the items that are left: the last ``favour`` or ``unfavour`` decides, ``delete`` removes.

    Items are ``(id, favourite)``; a null favourite is false. Changes of unknown items do nothing.
    """
    last = changes.where("op IN ('favour', 'unfavour')").groupBy("id").agg(F.max_by("op", "seq").alias("__op"))
    left = items.join(changes.where("op = 'delete'").select("id"), "id", "left_anti").join(last, "id", "left")
    return left.select("id", F.coalesce(F.col("__op") == "favour", "favourite", F.lit(False)).alias("favourite"))


def cpu_only(hardware: Column) -> Column:
    """Whether text is encoded without the accelerator: ``iPhone11,8`` is, ``iPhone12,1`` and other names are not."""
    number = F.regexp_extract(hardware, rf"^,*(?:{'|'.join(FAMILIES)})([+-]?[0-9]+),+[^,]+,*$", 1)
    return F.coalesce(F.nullif(number, F.lit("")).try_cast("long") < FIRST_ACCELERATED, F.lit(False))


def paused(low_power: Column, heat: Column) -> Column:
    """Whether indexing pauses; unknown states do not pause it."""
    return F.coalesce(low_power, F.lit(False)) | F.coalesce(heat.isin(*HOT_STATES), F.lit(False))


def rests(done: Column) -> Column:
    """Whether indexing rests after ``done`` items: at the first fragment of every 500."""
    return done % REST_EVERY < FRAGMENT
