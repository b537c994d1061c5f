"""Connected components of an edge table by rounds of contraction.

In each round every node points to the neighbour (or itself) with the smallest digest, digests being new
in each round; the edges between the nodes pointed to make the next, smaller table. The rounds' maps are
written to the shared folder and joined up at the end. Nothing is collected, and a hub's edges are summed
before they are shuffled (a minimum) or split by Spark's skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.runtime import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(src, dst) long pairs to (node, component): the smallest node reachable, for every node with an edge."""
    used: list[str] = []

    def save(df: DataFrame, what: str) -> DataFrame:
        used.append(f"{name}-{what}")
        return scratch.save(df, used[-1])

    tidy = edges.where(F.col("src") != F.col("dst")).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    e = save(tidy.distinct(), "edges-0")
    maps: list[DataFrame] = []
    while not e.isEmpty():
        level = len(maps)
        digest = lambda c: F.struct(F.xxhash64(F.lit(level), c).alias("h"), F.col(c).alias("node"))
        both = e.select("src", "dst").unionAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        near = both.groupBy("src").agg(F.min(digest("dst")).alias("m"))
        to = save(near.select(F.col("src").alias("node"), F.least(F.col("m"), digest("src"))["node"].alias("rep")), f"map-{level}")
        maps.append(to)
        moved = e.join(to.select(F.col("node").alias("src"), F.col("rep").alias("a")), "src").join(to.select(F.col("node").alias("dst"), F.col("rep").alias("b")), "dst")
        moved = moved.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
        e = save(moved, f"edges-{level + 1}")
        scratch.drop(f"{name}-edges-{level}")
    if not maps:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    found = maps[0]
    for to in maps[1:]:
        found = found.join(to.select(F.col("node").alias("rep"), F.col("rep").alias("further")), "rep", "left").select("node", F.coalesce("further", "rep").alias("rep"))
    found = scratch.save(found, f"{name}-found")
    least = found.groupBy("rep").agg(F.min("node").alias("component"))
    out = scratch.save(found.join(least, "rep").select("node", "component"), f"{name}-out")
    scratch.drop(f"{name}-found", *used)
    return out
