"""Near-duplicate vectors: every pair with cosine at or above a threshold, by quantised tile products.

Vectors are scaled to length 1 and coded in int8 with a scale each. With x = s*q + e the product of two vectors
differs from s*s'*q.q' by at most |e| + |e'| + |e||e'|; the lengths of the residuals e travel with the codes.
Coded vectors are gathered into tiles of a bounded size, and each pair of tiles is multiplied: pairs surely above
the threshold count at once, those surely below it are dropped, and of the others the rows concerned (not the
pairs) are told. Only these rows' full vectors are fetched, for each pair of tiles, and their doubtful pairs are
computed again in double precision. Both steps report how many links each vector has, and a spanning forest of
the links in place of the links, so a group of copies is never spelled out in pairs.

The work is that of all tile pairs, as the method has it, and each tile (an eighth of the full vectors) is sent
to as many tasks as there are tiles; memory is two tiles and a slab of products.

Edge cases: a vector that is null, empty, zero or holds null or non-finite components links with
nothing, is a component of its own and is kept; vectors of different lengths never link; repeated rows
are vectors of their own (the same id twice links with itself); an empty table gives an empty result;
other columns are ignored here.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.components import components
from vecloom.runtime import Scratch, ship, shuffle_partitions, table

THRESHOLD = 0.95
TILE_BYTES = 2 << 20
#: Smaller tiles are made only down to this many rows, to give every core a pair.
LEAST_ROWS = 1024
SLAB = 1 << 23
FLOAT_SLACK = 1e-5


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and the residuals' lengths of unit vectors."""
    scale = np.abs(x).max(1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    gap = x - codes * scale[:, None]
    return codes, scale, np.sqrt((gap * gap).sum(1)) * (1 + 1e-9)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component, for links (a, b) among n nodes."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


Codes = tuple[np.ndarray, np.ndarray, np.ndarray]


def compare(one: Codes, other: Codes | None, threshold: float):
    """Pairs of rows (of one tile with itself: i < j): surely at the threshold or above, and doubtful ones."""
    cx, sx, ex = one
    cy, sy, ey = other or one
    # int8 codes: their products are whole numbers, exact here
    kind = np.float32 if cx.shape[1] <= 1024 else np.float64
    left, right = cx.astype(kind), np.ascontiguousarray(cy.astype(kind).T)
    sure, doubt = [], []
    slab = max(1, SLAB // max(1, len(cy)))
    for at in range(0, len(cx), slab):
        rows = slice(at, at + slab)
        first = at if other is None else 0
        approx = left[rows] @ right[:, first:]
        approx *= sx[rows, None].astype(kind)
        approx *= sy[None, first:].astype(kind)
        most = ex[rows].max() + ey[first:].max() * (1 + ex[rows].max())
        i, j = np.nonzero(approx >= threshold - most - FLOAT_SLACK)
        near = approx[i, j].astype(np.float64)
        i, j = i + at, j + first
        if other is None:
            ok = i < j
            i, j, near = i[ok], j[ok], near[ok]
        bound = ex[i] + ey[j] * (1 + ex[i]) + FLOAT_SLACK
        yes = near - bound >= threshold
        perhaps = ~yes & (near + bound >= threshold)
        sure.append((i[yes], j[yes]))
        doubt.append((i[perhaps], j[perhaps]))
    none = [(np.zeros(0, int), np.zeros(0, int))]
    return tuple(tuple(map(np.concatenate, zip(*(found or none)))) for found in (sure, doubt))


def exactly(x: np.ndarray, y: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The doubtful pairs of unit vectors that are at the threshold or above in double precision."""
    i, j = compare(quantise(x), None if y is None else quantise(y), threshold)[1]
    full = x if y is None else y
    ok = np.zeros(len(i), bool)
    for k in range(0, len(i), 1 << 16):
        part = slice(k, k + (1 << 16))
        ok[part] = np.einsum("ij,ij->i", x[i[part]], full[j[part]]) >= threshold
    return i[ok], j[ok]


TOLD = pa.schema([("d", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("row", pa.int64()), ("links", pa.int64()), ("root", pa.int64()), ("second", pa.bool_()), ("doubt", pa.bool_())])


def told(key, ids: list[np.ndarray], sure, doubt) -> pa.Table:
    """Links of rows, their forest's roots, and rows whose pairs are doubtful: rows of which something is to be told."""
    every, shift = np.concatenate(ids), len(ids[0]) if len(ids) > 1 else 0
    i, j = sure[0], sure[1] + shift
    n = np.bincount(i, minlength=len(every)) + np.bincount(j, minlength=len(every))
    unsure = np.zeros(len(every), bool)
    unsure[doubt[0]] = unsure[doubt[1] + shift] = True
    root = forest(len(every), i, j)
    has = np.flatnonzero((n > 0) | unsure)
    d, a, b = (np.full(len(has), k.as_py(), np.int32) for k in key)
    return pa.table([d, a, b, every[has], n[has], every[root[has]], has >= len(ids[0]) if shift else np.zeros(len(has), bool), unsure[has]], schema=TOLD)


def coded(batches):
    """row, d, codes, scale and residual of each vector."""
    for b in batches:
        lists = b.column("v")
        sizes = lists.value_lengths().to_numpy()
        for d in np.unique(sizes):
            at = pa.array(np.flatnonzero(sizes == d))
            x = unit(lists.take(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, int(d)))
            codes, scale, gap = quantise(x)
            cols = [b.column("row").take(at), pa.array(np.full(len(x), d, np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), pa.array(gap)]
            yield pa.RecordBatch.from_arrays(cols, names=["row", "d", "codes", "scale", "gap"])


def to_tile(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    raw = lambda name: t.column(name).to_numpy().tobytes()
    return pa.table({"d": pa.array([key[0].as_py()], pa.int32()), "tile": pa.array([key[1].as_py()], pa.int32()), **{n: pa.array([v], pa.binary()) for n, v in (("ids", raw("row")), ("codes", b"".join(t.column("codes").to_pylist())), ("scale", raw("scale")), ("gap", raw("gap")))}})


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vector."""
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "embedding-dedup")
    v = F.col(vec_col).cast("array<double>")
    good = F.col(vec_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("__id"), F.when(F.coalesce(good, F.lit(False)), v).alias("v"))
    rows = scratch.save(rows, "rows")
    dims = {r["d"]: r["n"] for r in rows.where("v IS NOT NULL").groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not dims:
        alone = F.col("__id")
        return rows.select(alone.alias(id_col), F.lit(0).cast("long").alias("n_links"), alone.cast("long").alias("component_id"), F.lit(True).alias("kept"))

    # small tables get more tiles than their size asks for, so that the pairs keep all cores busy
    least = lambda n: min(-(-n // LEAST_ROWS), 1 + int((2 * shuffle_partitions(spark)) ** 0.5))
    counts = spark.createDataFrame([(d, max(1, -(-n * d // TILE_BYTES), least(n))) for d, n in dims.items()], "d int, tiles int")
    codes = rows.where("v IS NOT NULL").select("row", "v").mapInArrow(coded, "row long, d int, codes binary, scale double, gap double").join(F.broadcast(counts), "d")
    tiles = codes.withColumn("tile", F.pmod(F.xxhash64(F.lit(10), "row"), F.col("tiles")).cast("int")).groupBy("d", "tile").applyInArrow(to_tile, "d int, tile int, ids binary, codes binary, scale binary, gap binary")
    tiles = scratch.save(tiles, "tiles").join(F.broadcast(counts), "d")
    paired = tiles.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("d", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "ids", "codes", "scale", "gap")

    def multiply(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        d = key[0].as_py()
        sides = sorted(t.select(["tile", "ids", "codes", "scale", "gap"]).to_pylist(), key=lambda r: r["tile"])
        ids = [np.frombuffer(s["ids"], np.int64) for s in sides]
        data = [(np.frombuffer(s["codes"], np.int8).reshape(-1, d), np.frombuffer(s["scale"]), np.frombuffer(s["gap"])) for s in sides]
        return told(key, ids, *compare(data[0], data[1] if len(data) > 1 else None, threshold))

    types = "d int, a int, b int, row long, links long, root long, second boolean, doubt boolean"
    first = scratch.save(paired.groupBy("d", "a", "b").applyInArrow(multiply, types), "first")
    scratch.drop("tiles")

    def resolve(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        d = key[0].as_py()
        x = unit(t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
        row, second = t.column("row").to_numpy(), t.column("second").to_numpy(zero_copy_only=False)
        none = (np.zeros(0, int), np.zeros(0, int))
        if key[1].as_py() == key[2].as_py():
            return told(key, [row], exactly(x, None, threshold), none)
        return told(key, [row[~second], row[second]], exactly(x[~second], x[second], threshold), none)

    doubtful = first.where("doubt").select("d", "a", "b", "row", "second").join(rows.select("row", "v"), "row")
    again = scratch.save(doubtful.groupBy("d", "a", "b").applyInArrow(resolve, types), "again")
    linked = first.unionByName(again).where("links > 0").select("row", "links", "root")
    sums = linked.groupBy("row").agg(F.sum("links").alias("n_links"))
    reach = components(linked.select(F.col("row").alias("src"), F.col("root").alias("dst")), scratch)
    members = rows.select("row", "__id").join(reach.withColumnRenamed("node", "row"), "row", "left").join(sums, "row", "left")
    members = scratch.save(members, "members")
    scratch.drop("rows", "first", "again", "cc-out")
    least = members.where("component IS NOT NULL").groupBy("component").agg(F.min("__id").alias("least"))
    out = members.join(least, "component", "left")
    component = F.when(F.col("component").isNull(), F.col("__id")).otherwise(F.col("least")).cast("long")
    return out.select(F.col("__id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("__id").eqNullSafe(component).alias("kept"))


ORACLE = """
WITH RECURSIVE n AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / s) AS u
  FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS s FROM embeddings)),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.u) = len(b.u)
  WHERE list_sum(list_transform(generate_series(1, len(a.u)), lambda i: a.u[i] * b.u[i])) >= 0.95),
r(v, m) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.v),
c AS (SELECT v AS vec_id, min(m) AS component_id FROM r GROUP BY 1)
SELECT vec_id, (SELECT count(*) FROM l WHERE a = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c
"""

def op10_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
