"""Near-duplicate documents by weighted Jaccard similarity of their 5-word shingles (0.8 or more).

Signatures are BagMinHash: each shingle of weight w owns Poisson processes over the discretised weights
(0, 1], (1, 2], (2, 4], (4, 8] ... as far as w reaches; a point has a time, a signature slot and a weight
inside its interval, and counts if that is at most w. A slot keeps its earliest point, so two documents
agree in a slot with exactly the probability of their weighted Jaccard similarity. Points come in order of
time and stop once every slot is taken, so a signature costs little more than its length.

1. Documents with the same multiset of shingles make one text class (a sum of digests).
2. Signatures of 128 slots make 32 bands of 4; classes that share a band are candidates (a pair of
   similarity 0.8 shares none with a chance of 5e-8).
3. In each band bucket every class is verified against the one that shares most buckets with others, by the
   exact overlap of the multisets, and the links found make components.
4. Buckets that still hold several components are searched again for links between different ones. In a
   bucket of up to 64 classes, pairs whose full signatures agree in at least 62 % of the slots are verified (a
   pair of similarity 0.8 falls under that with a chance of 1e-6), each in the first band that it shares.
   Larger buckets are compared whole: in pairs of chunks of bounded size, the overlaps of all rows are one
   matrix product over the shingles that two of them share, and of the links found one goes on for each pair
   of components.

So pairs within a large group are never spelled out, and no link between components is lost.

Words are runs of letters, digits and _ of the lower-case text; a text with fewer than five is one shingle.

Rows are numbered once, in a table saved at the start, and known by that number; ids may be of any type that
sorts. Classes are told by 128-bit digests of their multisets, links by the multisets themselves. Joins that
deal rows by bucket are broadcast joins up to a checked size and salted beyond it, since one bucket can hold
any share of the rows; buckets compared whole are dealt out in pairs of chunks, so that the work on one, and
the copies of its rows sent, grow with the square of its unlinked members over 1,024.

Edge cases: a null or empty text, or one without a word, is a class of its own; of rows that repeat both id
and text all are returned by :func:`near_classes` and one stays in :func:`drop_near_duplicates`; rows that
repeat an id with another text are documents of their own; an empty table gives an empty result; other columns
are ignored here and kept by :func:`drop_near_duplicates`, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.components import components
from vecloom.llm.textkit import BASE, U, fresh, groups, mix, release, slices, strings, words
from vecloom.runtime import Scratch, ship, table

WORDS = 5
THRESHOLD = 0.8
SLOTS, BANDS = 128, 32
LEAST_AGREEMENT = 0.62
SMALL_BUCKET = 64
CHUNK_ROWS, CHUNK_UNITS, SLICE = 1024, 400_000, 2048
LARGEST_BROADCAST, SALTS = 50_000, 64


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, digest and weight of the distinct shingles of each text, in order of row and digest."""
    raw = [t.lower().encode() for t in texts]
    start, _, word = words(b"\n".join([*raw, b""]))
    ends = np.cumsum([len(r) + 1 for r in raw])
    row = np.searchsorted(ends, start, side="right")
    n = np.bincount(row, minlength=len(texts))
    begin = np.cumsum(n) - n
    h = np.zeros(max(0, len(word)), U)
    count = np.maximum(n - WORDS + 1, (n > 0).astype(int))
    at = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
    size = np.minimum(n, WORDS)[np.repeat(np.arange(len(texts)), count)]
    h = size.astype(U)
    padded = np.append(word, np.zeros(WORDS, U))
    for k in range(WORDS):
        h = h * U(BASE) + np.where(k < size, padded[at + k], U(0))
    h = mix(h)
    of = np.repeat(np.arange(len(texts)), count)
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (of[1:] != of[:-1]) | (h[1:] != h[:-1])
    first = np.flatnonzero(new)
    return of[first], h[first], np.diff(np.append(first, len(h)))


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from digests."""
    return ((x >> U(11)).astype(np.float64) + 1) * 2.0**-53


def signatures(n: int, row: np.ndarray, digest: np.ndarray, weight: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """BagMinHash signatures of n rows: the earliest time of each slot."""
    tiers = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(int) + 1, 1)
    tier = np.arange(tiers.sum()) - np.repeat(np.cumsum(tiers) - tiers, tiers)
    of, w = np.repeat(row, tiers), np.repeat(weight, tiers)
    low = np.where(tier == 0, 0, 2.0 ** (tier - 1))
    rate = np.maximum(low, 1.0)
    seed = mix(np.repeat(digest, tiers) + tier.astype(U) * U(0xA0761D6478BD642F))
    total = np.bincount(row, weight, n)
    horizon = slots * (math.log(slots) + 3) / np.maximum(total, 1)
    out = np.full(n * slots, np.inf)
    time, turn = np.zeros(len(seed)), 0
    live = np.arange(len(seed))
    parked: list[np.ndarray] = []
    while len(live):
        seed[live] = mix(seed[live] + U(0x9E3779B97F4A7C15))
        s = seed[live]
        time[live] -= np.log(uniform(s)) / rate[live]
        t, r = time[live], of[live]
        # a point past the horizon still counts: it is the process's next one, whatever the horizon is
        other = mix(s ^ U(0x8BB84B93962EACC9))
        ok = low[live] + rate[live] * uniform(other) <= w[live]
        slot = (other & U(slots - 1)).astype(np.int64)
        np.minimum.at(out, r[ok] * slots + slot[ok], t[ok])
        inside = t <= horizon[r]
        parked.append(live[~inside])
        live = live[inside]
        if not len(live):
            taken = out.reshape(n, slots).max(1)
            late = (taken > horizon) & (total > 0)
            if late.any():
                horizon = np.where(late, np.where(np.isinf(taken), 2 * horizon, taken), horizon)
                rest = np.concatenate(parked)
                again = late[of[rest]] & (time[rest] <= horizon[of[rest]])
                live, parked = rest[again], [rest[~again]]
                if not len(live) and np.isinf(taken[late]).any():
                    live, parked = rest[late[of[rest]]], [rest[~late[of[rest]]]]
    return out.reshape(n, slots)


def bands(sig: np.ndarray, count: int = BANDS) -> np.ndarray:
    """A digest for each band of each signature."""
    bits = np.ascontiguousarray(sig).view(U).reshape(len(sig), count, -1)
    h = np.broadcast_to(np.arange(1, count + 1, dtype=U) * U(0xE7037ED1A0B428DB), (len(sig), count)).copy()
    for k in range(bits.shape[2]):
        h = mix(h * U(BASE) + bits[:, :, k])
    return h


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of least over sum of greatest weights, of two (digests in order, weights)."""
    total = a[1].sum() + b[1].sum()
    at = np.minimum(np.searchsorted(a[0], b[0]), max(len(a[0]) - 1, 0))
    both = a[0][at] == b[0] if len(a[0]) else np.zeros(len(b[0]), bool)
    least = np.minimum(a[1][at[both]], b[1][both]).sum()
    return float(least) / float(total - least) if total else 0.0


def _sign(batches):
    for b in batches:
        for part in slices(b, "text", 1 << 19):
            n = part.num_rows
            row, digest, weight = shingles(strings(part.column("text")))
            has = np.bincount(row, minlength=n) > 0
            sums = []
            for k in (1, 2):
                s = np.zeros(n, U)
                np.add.at(s, row, mix(mix(digest + U(k)) * weight.astype(U) + weight.astype(U)))
                sums.append(s.view(np.int64))
            sig = signatures(n, row, digest, weight)
            band = bands(sig).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("node"),
                    part.column("id"),
                    *[pa.array(s, pa.int64(), mask=~has) for s in sums],
                    pa.array([x if h else None for x, h in zip(band, has)], pa.list_(pa.int64())),
                    pa.array([x.astype(np.float32).tobytes() if h else None for x, h in zip(sig, has)], pa.binary()),
                ],
                names=["node", "id", "d1", "d2", "bands", "sig"],
            )


def _verifier(threshold: float):
    def verify(batches):
        for b in batches:
            src, dst = b.column("src").to_numpy(), b.column("dst").to_numpy()
            keep = np.zeros(b.num_rows, bool)
            ta, tb = strings(b.column("a")), strings(b.column("b"))
            known: dict[int, tuple] = {}

            def of(key, text):
                if key not in known:
                    if len(known) > 2000:
                        known.clear()
                    known[key] = shingles([text])[1:]
                return known[key]

            for i in range(b.num_rows):
                keep[i] = similarity(of(src[i], ta[i]), of(dst[i], tb[i])) >= threshold - 1e-12
            yield pa.RecordBatch.from_arrays([pa.array(src[keep], pa.int64()), pa.array(dst[keep], pa.int64())], names=["src", "dst"])
            release()

    return verify


def _cross(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """Pairs of a small bucket in different components whose signatures agree often enough, and in no earlier band."""
    node, part, band = (t.column(c).to_numpy() for c in ("node", "component", "band"))
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.float32).reshape(-1, SLOTS)
    src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(len(node)):
        js = np.flatnonzero((part != part[i]) & (node > node[i]))
        if len(js):
            same = sig[js] == sig[i]
            first = same.reshape(len(js), BANDS, -1).all(2).argmax(1)
            js = js[(same.mean(1) >= LEAST_AGREEMENT) & (first >= band[i])]
            src.append(np.full(len(js), node[i]))
            dst.append(node[js])
    return pa.table({"src": np.concatenate(src), "dst": np.concatenate(dst)})


def _units(batches):
    """Shingles of each text as a set: the k-th time of a shingle is a unit of its own."""
    for b in batches:
        nodes, texts = b.column("node"), strings(b.column("text"))
        for a, z in groups([len(t) for t in texts], 1 << 20, 512):
            row, digest, weight = shingles(texts[a:z])
            again = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
            unit = mix(np.repeat(digest, weight) + again.astype(U) * U(0x9FB21C651E98DF25))
            n = np.bincount(row, weight, z - a).astype(np.int64)
            parts = np.split(unit, np.cumsum(n)[:-1])
            yield pa.RecordBatch.from_arrays([nodes.slice(a, z - a), pa.array(n, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["node", "n_units", "units"])


def overlaps(units: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many units each row of ``left`` shares with each row of ``right``: a product of slices of the 0/1 matrix."""
    row = np.repeat(np.arange(len(units)), [len(u) for u in units])
    _, unit, count = np.unique(np.concatenate(units), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    keep = shared[unit]
    row, unit = row[keep], place[unit[keep]]
    order = np.argsort(unit, kind="stable")
    row, unit = row[order], unit[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(shared.sum()), SLICE):
        a, z = np.searchsorted(unit, (at, at + SLICE))
        m = np.zeros((len(units), SLICE), np.float32)
        m[row[a:z], unit[a:z] - at] = 1
        out += m[left] @ m[right].T
    return out


def _exact(threshold: float):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        """Links between different components of a large bucket's chunk pair, one for each pair of components."""
        low, high = key[1].as_py(), key[2].as_py()
        chunk, node, part, n = (t.column(c).to_numpy() for c in ("chunk", "node", "component", "n_units"))
        left, right = np.flatnonzero(chunk == low), np.flatnonzero(chunk == high)
        if low == high:  # whatever links with the largest component is on the other side then
            names, sizes = np.unique(part[left], return_counts=True)
            left = left[part[left] != names[sizes.argmax()]]
        if not len(left) or not len(right):
            return pa.table({"src": np.zeros(0, np.int64), "dst": np.zeros(0, np.int64)})
        units = [np.frombuffer(u, U) for u in t.column("units").to_pylist()]
        both = overlaps(units, left, right).astype(np.float64)
        i, j = np.nonzero((both >= threshold * (n[left][:, None] + n[right][None, :] - both) - 1e-9) & (part[left][:, None] != part[right][None, :]))
        i, j = left[i], right[j]
        pair = np.stack([np.minimum(part[i], part[j]), np.maximum(part[i], part[j])], 1)
        one = np.unique(pair, axis=0, return_index=True)[1] if len(pair) else np.zeros(0, np.int64)
        return pa.table({"src": node[i[one]], "dst": node[j[one]]})

    return run


def _joined(rows: DataFrame, small: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Join on ``bucket`` of rows of which one bucket can hold any share: broadcast up to a checked size, salted beyond it."""
    small = scratch.save(small, name)
    if small.limit(LARGEST_BROADCAST + 1).count() <= LARGEST_BROADCAST:
        return rows.join(F.broadcast(small), "bucket")
    spread = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(F.lit(7), "node"), F.lit(SALTS)).cast("int")).join(spread, ["bucket", "salt"]).drop("salt")


def _members(rows: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """Rows (node, id, text), each with a node of its own, to node, id, has (a word), component: one row per input row."""
    spark = rows.sparkSession
    ship(spark)
    kind = rows.schema["id"].dataType.simpleString()
    signed = scratch.save(rows.mapInArrow(_sign, f"node long, id {kind}, d1 long, d2 long, bands array<long>, sig binary"), "signed")

    # 1: text classes; the node of a class is its least one
    classes = signed.where("d1 IS NOT NULL").groupBy("d1", "d2").agg(F.min("node").alias("rep"))
    classes = scratch.save(classes, "classes")
    reps = signed.join(classes, ["d1", "d2"]).where(F.col("node") == F.col("rep")).select("node", "bands", "sig")
    reps = scratch.save(reps, "reps")

    # 2: buckets of two classes or more
    entries = reps.select("node", F.posexplode("bands").alias("band", "bucket"))
    sized = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = scratch.save(entries.join(sized, "bucket"), "members")
    known = members.groupBy("node").agg(F.sum("n").alias("shared"))
    centres = members.join(known, "node").groupBy("bucket").agg(F.max(F.struct("shared", "node"))["node"].alias("centre"))
    wanted = members.select("node").distinct()
    texts = scratch.save(rows.select("node", "text").join(wanted, "node"), "texts")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        a, b = texts.select(F.col("node").alias("src"), F.col("text").alias("a")), texts.select(F.col("node").alias("dst"), F.col("text").alias("b"))
        return scratch.save(pairs.join(a, "src").join(b, "dst").select("src", "dst", "a", "b").mapInArrow(_verifier(threshold), "src long, dst long"), name)

    # 3: each class against one of its bucket
    star = members.join(centres, "bucket").where("node != centre").select(F.least("centre", "node").alias("src"), F.greatest("centre", "node").alias("dst")).distinct()
    links = verified(star, "star")
    part = components(links, scratch, "first")

    # 4: links between the components that are left in a bucket
    where = members.join(part.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    where = scratch.save(where, "where")
    open_ = where.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("bucket")
    where = scratch.save(where.join(open_, "bucket"), "open")
    small = where.where(F.col("n") <= SMALL_BUCKET).join(reps.select("node", "sig"), "node")
    cross = small.groupBy("bucket").applyInArrow(_cross, "src long, dst long").distinct()
    large = where.where(F.col("n") > SMALL_BUCKET)
    units = texts.join(large.select("node").distinct(), "node").select("node", "text").mapInArrow(_units, "node long, n_units long, units binary")
    units = scratch.save(units, "units")
    weights = large.join(units.select("node", "n_units"), "node").groupBy("bucket").agg(F.greatest(F.ceil(F.sum("n_units") / CHUNK_UNITS), F.ceil(F.count(F.lit(1)) / CHUNK_ROWS)).cast("int").alias("chunks"))
    dealt = _joined(large, weights, scratch, "weights").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("bucket", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "node", "component")
    whole = dealt.join(units, "node").groupBy("bucket", "low", "high").applyInArrow(_exact(threshold), "src long, dst long").distinct()
    whole = scratch.save(whole, "whole")
    more = verified(cross, "cross")
    reach = components(links.unionByName(more).unionByName(whole), scratch, "second")

    member = signed.select("node", "id", "d1", "d2").join(classes, ["d1", "d2"], "left").withColumn("rep", F.coalesce("rep", "node"))
    member = member.join(reach.select(F.col("node").alias("rep"), "component"), "rep", "left").select("node", "id", F.col("d1").isNotNull().alias("has"), F.coalesce("component", "rep").alias("component"))
    member = scratch.save(member, "member")
    scratch.drop("signed", "texts", "members", "where", "open", "units", "weights", "reps", "classes", "star", "whole", "cross", "first-out", "second-out")
    return member


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, class_id (the least id of its class), class_size, kept: one row per input row."""
    scratch = Scratch(docs.sparkSession, "minhash-dedup")
    rows = docs.select(F.monotonically_increasing_id().alias("node"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    member = _members(scratch.save(rows, "rows"), threshold, scratch)
    scratch.drop("rows")
    size = member.where("has").groupBy("component").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size"))
    out = member.join(scratch.save(size, "size"), "component", "left")  # a saved side lets Spark split a hot component
    class_id = F.when(F.col("has"), F.col("least")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), class_id.alias("class_id"), F.when(F.col("has"), F.col("size")).otherwise(F.lit(1)).cast("long").alias("class_size"), F.col("id").eqNullSafe(class_id).alias("kept"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay if of each class one does: the least id's (of rows that
    repeat id and text, the first). Rows without a word all stay."""
    scratch = Scratch(docs.sparkSession, "minhash-stage")
    node = fresh(docs, "node")
    rows = scratch.save(docs.withColumn(node, F.monotonically_increasing_id()), "rows")
    member = _members(rows.select(F.col(node).alias("node"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), threshold, scratch)
    stays = member.where("has").groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "node"))["node"].alias("stay"))
    gone = member.where("has").join(scratch.save(stays, "stays"), "component").where(F.col("node") != F.col("stay")).select(F.col("node").alias(node))
    left = rows.join(scratch.save(gone, "gone"), node, "left_anti")
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_\x{80}-\x{10FFFF}]+') AS w FROM documents),
s AS (
  SELECT doc_id, s, count(*) AS c
  FROM (SELECT doc_id, unnest(list_transform(generate_series(1, greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) > 0)
  GROUP BY 1, 2),
t AS (SELECT doc_id, sum(c) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.c, b.c)) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN t x ON x.doc_id = p.a JOIN t y ON y.doc_id = p.b WHERE 5 * o >= 4 * (x.n + y.n - o)),
r(v, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.v),
c AS (SELECT v AS doc_id, min(m) AS class_id FROM r GROUP BY 1)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, doc_id = class_id AS kept FROM c
"""

def op5_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))
