"""Named queries over the driver's tables and the SQL that gives the same rows.

The tables play the parts of the retrieval domain: ``embeddings`` is the index, ``labels`` the visible
items, ``events`` the change log (signup adds, purchase edits, error deletes item event_id % 500) and the
timing samples, ``documents`` the library and the prompts.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions import ranking, text, tokenizer, vector
from vecloom.operators import benchmarks, encoders, library as media, ordering, packed, parity, search, store_log, sync
from vecloom.runtime import Scratch, ship, table
from vecloom.sources import coordinator, durable, generators, spec, store
from vecloom.types import DEFAULT_K, TOKEN_FIXTURE, EngineError

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
D = 64


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def index(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def changes(spark, d) -> DataFrame:
    """(seq, op, id, event_type) of the change log."""
    op = F.when(F.col("event_type").isin("signup", "purchase"), "U").when(F.col("event_type") == "error", "D")
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), op.alias("op"), (F.col("event_id") % 500).alias("id"), "event_type", "ts").where("op IS NOT NULL")


def one(spark, **values) -> DataFrame:
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


NORM = "sqrt(list_reduce(list_transform({0}, lambda x: x::DOUBLE * x::DOUBLE), lambda a, b: a + b))"
N_E = NORM.format("embedding")
DOT = "list_reduce(list_transform(generate_series(1, len({0})), lambda i: {1}), lambda a, b: a + b)"
UNIT = f"SELECT vec_id, label, embedding, list_transform(embedding, lambda x: x::DOUBLE / n) AS u, n FROM (SELECT *, {N_E} AS n FROM embeddings)"
SCORE = "CAST(least(1.0, greatest(-1.0, " + DOT.format("e.embedding", "q.u[i] * e.u[i]") + ")) AS FLOAT)"
SCORED = f"WITH n AS ({UNIT}), s AS (SELECT e.vec_id AS id, e.label, {SCORE} AS score FROM n e, (SELECT u FROM n WHERE vec_id = 0) q)"
RANKED = "SELECT row_number() OVER (ORDER BY score DESC, id) AS rank, id, score FROM s {0} ORDER BY score DESC, id LIMIT {1}"
CHANGES = "SELECT event_id AS seq, CASE WHEN event_type IN ('signup', 'purchase') THEN 'U' ELSE 'D' END AS op, event_id % 500 AS id, event_type, ts FROM events WHERE event_type IN ('signup', 'purchase', 'error')"

# retrieval


@query(f"{SCORED} {RANKED.format('', DEFAULT_K)}")
def similar_topk(spark, d):
    return search.item_query(index(spark, d), 0, D)


@query(
    f"WITH n AS ({UNIT}), s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {SCORE} AS score FROM n e, n q WHERE q.vec_id % 100 = 0), "
    "r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score FROM s) SELECT * FROM r WHERE rank <= 10"
)
def search_batch_topk(spark, d):
    rows = index(spark, d)
    return search.batch_top(rows.select("id", "embedding"), rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding"), 10, D)


@query(f"{SCORED} {RANKED.format('WHERE id IN (SELECT doc_id FROM labels)', DEFAULT_K)}")
def search_visible_topk(spark, d):
    return search.item_query(index(spark, d), 0, D, visible=table(spark, d, "labels").select(F.col("doc_id").alias("id")))


@query(f"{SCORED} {RANKED.format('WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1)', DEFAULT_K)}")
def search_library_topk(spark, d):
    return search.item_query(index(spark, d), 0, D, visible=table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id")))


@query("SELECT CAST(-5 AS INTEGER) AS k, CAST(0 AS BIGINT) AS n")
def search_k_clamped(spark, d):
    return search.item_query(index(spark, d), 0, D, k=-5).agg(F.count(F.lit(1)).alias("n")).select(F.lit(-5).alias("k"), "n")


@query("SELECT 'NEVER_INDEXED' AS empty_index, 'dimensionMismatch' AS bad_query, 'NO_RESULT' AS nothing_visible")
def search_empty_index_status(spark, d):
    rows = index(spark, d).select("id", "embedding")
    none = rows.where(F.lit(False))
    try:
        search.search(search.VectorIndex.publish(none, D), [1.0] * (D - 1))
        code = "accepted"
    except EngineError as e:
        code = e.code
    nothing = search.item_query(rows, 0, D, visible=none.select("id"))
    return one(spark, empty_index=search.status(none, None), bad_query=code, nothing_visible=search.status(rows, nothing))


@query(f"{SCORED} {RANKED.format('WHERE label = 3', 20)}")
def search_album_topk(spark, d):
    rows = index(spark, d)
    return search.item_query(rows, 0, D, k=20, visible=rows.where("label = 3").select("id"))


@query()
def search_float16_topk(spark, d):
    published = search.VectorIndex.publish(index(spark, d).select("id", "embedding"), D)
    return search.similar(published, 0, backend="arrow")


@query("SELECT true AS agrees, 120::BIGINT AS n")
def packed_agreement(spark, d):
    rows = index(spark, d).select("id", "embedding")
    built = packed.PackedIndex.build(rows, D)
    q = search.VectorIndex(rows, D).vector_of(0)
    both = built.search({"q": q}).withColumnRenamed("score", "half").join(search.score(search.VectorIndex(rows, D), q), "id")
    return both.agg((F.max(F.abs(F.col("half") - F.col("score"))) <= 2e-3).alias("agrees"), F.count(F.lit(1)).alias("n"))


@query(f"{SCORED} {RANKED.format('', 30)}")
def backend_fallback(spark, d):
    def broken(*_):
        raise EngineError("indexUnavailable")

    published = search.VectorIndex.publish(index(spark, d).select("id", "embedding"), D)
    return search.search(published, published.vector_of(0), 30, backend="arrow", scorer=broken)


@query("SELECT true AS agrees, count(*) AS n FROM embeddings")
def float16_agreement(spark, d):
    published = search.VectorIndex.publish(index(spark, d).select("id", "embedding"), D)
    q = published.vector_of(0)
    both = search.score(published, q).withColumnRenamed("score", "exact").join(search.score_half(published, q), "id")
    return both.agg((F.max(F.abs(F.col("exact") - F.col("score"))) <= 2e-3).alias("agrees"), F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM (VALUES ('missing item', 'referencePhotoMissing'), ('not finite', 'nonFiniteVector'), ('short', 'dimensionMismatch'), ('sound', 'accepted'), ('zero', 'zeroNormVector'), ('zero, not visible', 'zeroNormVector'), ('batch, short', 'dimensionMismatch')) t(rows, outcome)")
def search_refuses_invalid(spark, d):
    """One invalid row, wherever it stands, fails every search."""
    rows = index(spark, d).select("id", "embedding")
    broken = lambda k: damaged(spark, d).where(F.col("id") % 50 == k).limit(1).unionByName(rows.where("id % 50 > 4"))
    seen = rows.where("id % 50 = 7").select("id")
    cases = {
        "sound": lambda: search.item_query(rows, 0, D),
        "missing item": lambda: search.item_query(rows, -1, D),
        "zero": lambda: search.item_query(broken(0), 7, D),
        "zero, not visible": lambda: search.item_query(broken(0), 7, D, visible=seen),
        "not finite": lambda: search.item_query(broken(1), 7, D),
        "short": lambda: search.item_query(broken(2), 7, D),
        "batch, short": lambda: search.batch_top(broken(2), rows.where("id = 7").select(F.col("id").alias("query_id"), "embedding"), 3, D),
    }
    out = []
    for name, run in cases.items():
        try:
            run()
            out.append((name, "accepted"))
        except EngineError as e:
            out.append((name, e.code))
    return spark.createDataFrame(out, "rows string, outcome string")


def against(spark, built, rows, item_vector) -> DataFrame:
    """id, agrees: all that a packed index holds, and whether each score is that of the row expected there."""
    held = built.search({"q": item_vector}, 1 << 30).select("id", F.col("score").alias("half"))
    exact = search.score(search.VectorIndex(rows, D), item_vector)
    return held.join(exact, "id", "left").select("id", F.coalesce(F.abs(F.col("half") - F.col("score")) <= 2e-3, F.lit(False)).alias("agrees"))


@query("SELECT vec_id AS id, true AS agrees FROM embeddings UNION ALL SELECT -vec_id, true FROM embeddings WHERE label = 3 AND vec_id > 0")
def packed_upsert(spark, d):
    """Label 3's vectors are turned round, under their ids and as new items."""
    rows = index(spark, d)
    q = search.VectorIndex(rows, D).vector_of(0)
    turned = rows.where("label = 3").select("id", F.transform("embedding", lambda x: -x).alias("embedding"))
    more = turned.unionByName(turned.where("id > 0").withColumn("id", -F.col("id")))
    built = packed.PackedIndex.build(rows.select("id", "embedding"), D).upsert(more)
    want = rows.where("label <> 3").select("id", "embedding").unionByName(more)
    return against(spark, built, want, q)


@query("SELECT vec_id AS id, true AS agrees FROM embeddings WHERE label <> 3")
def packed_remove(spark, d):
    rows = index(spark, d)
    q = search.VectorIndex(rows, D).vector_of(0)
    gone = rows.where("label = 3").select("id").unionByName(spark.range(-5, 0).select("id"))
    built = packed.PackedIndex.build(rows.select("id", "embedding"), D).remove(gone)
    return against(spark, built, rows.select("id", "embedding"), q)


@query("SELECT vec_id AS id FROM embeddings WHERE label = 3 AND vec_id IN (SELECT doc_id FROM labels)")
def search_results_pruned(spark, d):
    """Results published before the library changed, cut down to what it still has."""
    rows = index(spark, d)
    published = rows.where("label = 3").select("id", F.lit(1.0).alias("score"))
    return search.visible_only(published, table(spark, d, "labels").select(F.col("doc_id").alias("id"))).select("id")


# vector functions


@query(f"SELECT vec_id AS id, round({N_E}, 9) AS norm FROM embeddings")
def vector_norms(spark, d):
    return index(spark, d).select("id", F.round(vector.norm(F.col("embedding")), 9).alias("norm"))


@query(f"WITH n AS ({UNIT}) SELECT vec_id AS id, round(list_reduce(list_transform(u, lambda x: x::FLOAT::DOUBLE), lambda a, b: a + b), 6) AS total, CAST(u[1] AS FLOAT) AS first FROM n")
def vector_normalize(spark, d):
    n = index(spark, d).select("id", vector.normalize(F.col("embedding")).alias("u"))
    return n.select("id", F.round(vector.total(F.transform("u", lambda x: x.cast("double"))), 6).alias("total"), F.col("u")[0].alias("first"))


PAIRS = f"WITH n AS ({UNIT}), p AS (SELECT e.vec_id AS id, e.embedding AS a, q.embedding AS b, e.u AS ua, q.u AS ub, e.n AS na, q.n AS nb FROM n e JOIN n q ON q.vec_id = e.vec_id + 1)"
COS = "CAST(least(1.0, greatest(-1.0, " + DOT.format("a", "ub[i] * ua[i]") + ")) AS FLOAT)"
RAW = "CAST(" + DOT.format("a", "a[i]::DOUBLE * b[i]::DOUBLE") + " / (na * nb) AS FLOAT)"


def pairs(spark, d) -> DataFrame:
    rows = index(spark, d)
    return rows.select("id", F.col("embedding").alias("a")).join(rows.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("b")), "id")


@query(f"{PAIRS} SELECT id, {COS} AS similarity FROM p")
def cosine_pairs(spark, d):
    return pairs(spark, d).select("id", vector.cosine(F.col("a"), F.col("b")).alias("similarity"))


@query(f"{PAIRS} SELECT id, {RAW} AS similarity FROM p")
def cosine_parity(spark, d):
    return pairs(spark, d).select("id", vector.cosine_raw(F.col("a"), F.col("b")).alias("similarity"))


@query(f"{PAIRS} SELECT id, CAST(1::FLOAT - {RAW} AS FLOAT) AS distance FROM p")
def cosine_distance(spark, d):
    return pairs(spark, d).select("id", vector.cosine_distance(vector.cosine_raw(F.col("a"), F.col("b"))).alias("distance"))


@query(f"{PAIRS} SELECT id, round(CAST(pow(acos({COS}::DOUBLE), 2) / 2 AS FLOAT)::DOUBLE, 5) AS loss FROM p")
def spherical_distance(spark, d):
    return pairs(spark, d).select("id", F.round(vector.spherical(vector.cosine(F.col("a"), F.col("b"))).cast("double"), 5).alias("loss"))


def damaged(spark, d) -> DataFrame:
    """The index with a broken vector in some rows of each fifty."""
    v = F.col("embedding")
    bad = F.when(F.col("id") % 50 == 0, F.transform(v, lambda x: F.lit(0).cast("float"))).when(F.col("id") % 50 == 1, F.transform(v, lambda x: F.lit(float("nan")).cast("float")))
    bad = bad.when(F.col("id") % 50 == 2, F.slice(v, 1, D - 1)).when(F.col("id") % 50 == 3, F.transform(v, lambda x: F.lit(float("inf")).cast("float"))).when(F.col("id") % 50 == 4, F.transform(v, lambda x: F.lit(1e-20).cast("float")))
    return index(spark, d).select("id", bad.otherwise(v).alias("embedding"))


@query("SELECT vec_id AS id, CASE vec_id % 50 WHEN 0 THEN 'zeroNormVector' WHEN 1 THEN 'nonFiniteVector' WHEN 2 THEN 'dimensionMismatch' WHEN 3 THEN 'nonFiniteVector' ELSE 'zeroNormVector' END AS error FROM embeddings WHERE vec_id % 50 <= 4")
def vector_validation_report(spark, d):
    return search.validation_report(damaged(spark, d), D)


@query("SELECT vec_id AS id, vec_id % 50 > 3 AS usable FROM embeddings")
def usable_vectors(spark, d):
    return damaged(spark, d).select("id", vector.is_usable(F.col("embedding"), D).alias("usable"))


HALF = "CASE WHEN x = 0 THEN x ELSE round_even(x / pow(2.0, greatest(floor(log2(abs(x))), -14) - 10), 0) * pow(2.0, greatest(floor(log2(abs(x))), -14) - 10) END"


@query(f"SELECT vec_id AS id, round(list_reduce(list_transform(list_transform(embedding, lambda e: e::DOUBLE), lambda x: {HALF}), lambda a, b: a + b), 9) AS total FROM embeddings")
def float16_round(spark, d):
    return index(spark, d).select("id", F.round(vector.total(F.transform(vector.to_half(F.col("embedding")), lambda x: x.cast("double"))), 9).alias("total"))


# the store

REPLAY = f"WITH c AS ({CHANGES}), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS k FROM c)"
FIRST = "round(embedding[1]::DOUBLE, 6) AS first"


def store_changes(spark, d) -> DataFrame:
    return changes(spark, d).join(F.broadcast(index(spark, d).select("id", "embedding").where("id < 500")), "id").withColumn("embedding", F.when(F.col("op") == "U", F.col("embedding")))


@query(f"{REPLAY} SELECT id, {FIRST} FROM r JOIN embeddings ON vec_id = id WHERE k = 1 AND op = 'U'")
def store_replay(spark, d):
    return store_log.replay(store_changes(spark, d)).select("id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query(f"SELECT vec_id AS id, round(CASE WHEN vec_id IN (SELECT event_id % 500 FROM events WHERE event_type = 'purchase') THEN -embedding[1] ELSE embedding[1] END::DOUBLE, 6) AS first FROM embeddings")
def store_upsert_merge(spark, d):
    base = index(spark, d).select("id", "embedding")
    touched = changes(spark, d).where("event_type = 'purchase'").select("id").distinct()
    new = base.join(touched, "id", "left_semi").select("id", F.transform("embedding", lambda x: -x).alias("embedding"))
    return store_log.upsert(base, new).select("id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT event_id % 500 FROM events WHERE event_type = 'error')")
def store_tombstones(spark, d):
    return store_log.delete(index(spark, d).select("id"), changes(spark, d).where("op = 'D'").select("id"))


@query("SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END AS part FROM embeddings WHERE vec_id NOT IN (SELECT event_id % 500 FROM events WHERE event_type = 'error')")
def store_legacy_replay(spark, d):
    rows = index(spark, d)
    main, journal = rows.select("id", F.lit(1).alias("embedding")), rows.where("id % 3 = 0").select("id", F.lit(2).alias("embedding"))
    return store_log.legacy(main, journal, changes(spark, d).where("op = 'D'").select("id")).withColumnRenamed("embedding", "part")


@query(f"{REPLAY}, l AS (SELECT id FROM r WHERE k = 1 AND op = 'U') SELECT count(*) AS live, count(*) AS compacted, true AS same FROM l")
def store_compaction_equivalence(spark, d):
    log = store_changes(spark, d)
    live = store_log.replay(log)
    compact = store_log.replay(store_log.segment_ops(0, live))
    both = live.select("id", F.lit(1).alias("a")).join(compact.select("id", F.lit(1).alias("b")), "id", "full_outer")
    return both.agg(F.count("a").alias("live"), F.count("b").alias("compacted"), F.every(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("same"))


def store_folder(spark) -> str:
    """A new folder for a store, on whatever file system the shared folder is."""
    return Scratch(spark, "store").root


def local_folder(spark) -> str:
    """A new mounted folder, for what the driver keeps or a Python data source writes: the shared one if it is mounted."""
    from vecloom.runtime import shared_folder

    base = shared_folder(spark).removeprefix("file://").removeprefix("file:")
    base = base if base.startswith("/") else tempfile.mkdtemp(prefix="vecloom-store-")
    place = Path(base) / f"store-{uuid.uuid4().hex}"
    place.mkdir(parents=True)
    return str(place)


def named(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").cast("string").alias("id"), "embedding")


@query("SELECT CAST(vec_id AS VARCHAR) AS id, CAST(3 AS BIGINT) AS revision FROM embeddings WHERE vec_id % 5 <> 0")
def store_durable_roundtrip(spark, d):
    s = store.VectorStore(spark, store_folder(spark), spec.S2.identity, "g1", D)
    rows = named(index(spark, d))
    s.commit(upserts=rows, checkpoint={"complete": False})
    s.commit(deletes=rows.where("cast(id as long) % 5 = 0").select("id"))
    s.compact()
    live, m = s.load()
    return live.select("id", F.lit(m["revision"]).cast("long").alias("revision"))


BEFORE = ("segmentWritten", "segmentSynced", "segmentVerified", "segmentFolderSynced", "manifestWritten")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{b}', {'CAST(1 AS BIGINT)' if b in BEFORE else 'CAST(2 AS BIGINT)'})" for b in store.BOUNDARIES) + ") t(boundary, revision)")
def store_fault_matrix(spark, d):
    rows = named(index(spark, d))
    found = []
    for boundary in store.BOUNDARIES:

        def fault(at, boundary=boundary):
            if at == boundary and armed:
                raise EngineError("crash", at)

        armed: list[int] = []
        folder = store_folder(spark)
        s = store.VectorStore(spark, folder, spec.S2.identity, "g1", D, fault=fault)
        s.commit(upserts=rows.where("cast(id as long) % 2 = 0"))
        armed.append(1)
        try:
            s.commit(upserts=rows)
        except EngineError:
            pass
        found.append((boundary, store.VectorStore(spark, folder, spec.S2.identity, "g1", D).load()[1]["revision"]))
    return spark.createDataFrame(found, "boundary string, revision long")


# keeping in step


def library(spark, d) -> DataFrame:
    return table(spark, d, "labels").select(F.col("doc_id").alias("id"))


@query("SELECT DISTINCT doc_id AS id FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 50 > 3)")
def sync_additions(spark, d):
    return sync.additions(library(spark, d), damaged(spark, d), D)


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def sync_deletions_full(spark, d):
    return sync.deletions(library(spark, d), index(spark, d), "full")


@query("SELECT CAST(0 AS BIGINT) AS n")
def sync_deletions_limited(spark, d):
    return sync.deletions(library(spark, d), index(spark, d), "limited").agg(F.count(F.lit(1)).alias("n"))


def versions(spark, d, kind: str) -> DataFrame:
    return changes(spark, d).where(F.col("event_type") == kind).groupBy("id").agg(F.max("ts").alias("version"))


VERSIONS = "SELECT event_id % 500 AS id, max(ts) AS version FROM events WHERE event_type = '{0}' GROUP BY 1"


@query(f"SELECT l.id FROM ({VERSIONS.format('purchase')}) l JOIN ({VERSIONS.format('signup')}) k ON l.id = k.id WHERE l.version <> k.version")
def sync_edited(spark, d):
    return sync.edited(versions(spark, d, "purchase"), versions(spark, d, "signup"))


@query(f"SELECT p.id FROM ({VERSIONS.format('purchase')}) p JOIN (SELECT id, CASE WHEN id % 2 = 0 THEN version END AS version FROM ({VERSIONS.format('purchase')})) l ON l.id = p.id AND l.version IS NOT DISTINCT FROM p.version")
def sync_version_fence(spark, d):
    now = versions(spark, d, "purchase")
    return sync.unchanged(now, now.select("id", F.when(F.col("id") % 2 == 0, F.col("version")).alias("version"))).select("id")


PROGRESS = "SELECT count(*) AS required, count(*) FILTER (ok) AS indexed, count(*) FILTER (has AND NOT ok) AS blank, count(*) FILTER (NOT ok) AS remaining FROM (SELECT DISTINCT doc_id, doc_id IN (SELECT vec_id FROM embeddings) AS has, doc_id IN (SELECT vec_id FROM embeddings WHERE vec_id % 50 > 3) AS ok FROM labels)"


@query(PROGRESS)
def sync_progress_counts(spark, d):
    return sync.progress(library(spark, d), damaged(spark, d), D)


@query(f"SELECT blank FROM ({PROGRESS})")
def sync_blank_count(spark, d):
    return sync.progress(library(spark, d), damaged(spark, d), D).select("blank")


@query("SELECT count(DISTINCT doc_id) AS remaining FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 50 > 3)")
def sync_remaining(spark, d):
    return sync.additions(library(spark, d), damaged(spark, d), D).agg(F.count(F.lit(1)).alias("remaining"))


@query(f"SELECT vec_id AS id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels) AND vec_id NOT IN (SELECT l.id FROM ({VERSIONS.format('purchase')}) l JOIN ({VERSIONS.format('signup')}) k ON l.id = k.id WHERE l.version <> k.version)")
def sync_reconcile(spark, d):
    rows = index(spark, d).select("id")
    known = versions(spark, d, "signup")
    now = library(spark, d).join(versions(spark, d, "purchase"), "id", "left")
    edits = sync.edited(versions(spark, d, "purchase"), known)
    return store_log.delete(store_log.delete(rows, sync.deletions(now, rows, "full")), edits)


@query(f"SELECT vec_id AS id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels) AND vec_id NOT IN (SELECT l.id FROM ({VERSIONS.format('purchase')}) l JOIN ({VERSIONS.format('signup')}) k ON l.id = k.id WHERE l.version <> k.version)")
def index_rows_deleted(spark, d):
    """Rows of items that were edited or are gone are deleted from the index itself."""
    now = library(spark, d).join(versions(spark, d, "purchase"), "id", "left")
    return sync.reconcile(index(spark, d).select("id"), now, versions(spark, d, "signup"), "full")


@query("SELECT fragment_no, batch_no, count(*) AS items, min(id) AS first_id, max(id) AS last_id FROM (SELECT id, CAST(floor(pos / 100) AS BIGINT) AS fragment_no, CAST(floor((pos % 100) / 32) AS BIGINT) AS batch_no FROM (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings)) GROUP BY 1, 2")
def batch_plan(spark, d):
    return sync.batch_plan(index(spark, d))


@query(f"{REPLAY} SELECT CAST(id AS VARCHAR) AS id FROM r WHERE k = 1 AND op = 'U'")
def stream_sync_final_state(spark, d):
    from vecloom.streaming import sync as stream

    scratch = Scratch(spark, "stream")
    src = scratch.path("changes")
    log = changes(spark, d).select("seq", "op", F.col("id").cast("string").alias("id"))
    log.repartitionByRange(3, "seq").write.parquet(src)
    s = store.VectorStore(spark, store_folder(spark), spec.S2.identity, "g1", 2)
    s.commit(checkpoint={"batch_id": -1})
    vectors = lambda df: df.select("id", F.array(F.lit(1.0).cast("float"), F.lit(2.0).cast("float")).alias("embedding"))
    source = spark.readStream.schema("seq long, op string, id string").parquet(src)
    stream.run(source, s, vectors, scratch.path("offsets")).awaitTermination()
    return s.load()[0].select("id")


@query("SELECT user_id, event_type, min(event_id) AS first_event FROM events WHERE value >= 0 GROUP BY 1, 2")
def late_duplicate_drop(spark, d):
    e = table(spark, d, "events").withColumn("final", F.col("value") >= 0)
    return sync.first_final(e, ["user_id", "event_type"], "event_id", "final").select("user_id", "event_type", F.col("event_id").alias("first_event"))


# encoders and prompts


def unsteady_encoder():
    """A batch that holds a text with '###' fails as a whole; alone, such a text fails."""
    good = encoders.digest_encoder(D)

    def run(texts):
        if any("###" in t for t in texts):
            raise ValueError("unreadable")
        return good(texts)

    return run


@query("SELECT doc_id AS id, contains(text, '###') AS failed FROM documents")
def encode_with_fallback(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("item"))
    return encoders.encode(rows, unsteady_encoder, D).select("id", "failed")


@query()
def text_search_topk(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("item"))
    built = encoders.encode(rows, lambda: encoders.digest_encoder(D), D).where("not failed").select("id", "embedding")
    built = Scratch(spark, "text-search").save(built, "index")
    published = search.VectorIndex.publish(built, D, spec.S2.identity)
    published.require(spec.S2.identity)
    return search.search(published, encoders.digest_encoder(D)(["the of and"])[0].tolist(), 50)


CLEAN = "trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"
WORDS = f"list_filter(string_split({CLEAN}, ' '), lambda w: w <> '')"


@query(f"SELECT doc_id AS id, md5({CLEAN}) AS cleaned FROM documents")
def text_basic_clean(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5(text.basic_clean(F.col("text")).cast("binary")).alias("cleaned"))


@query(f"SELECT doc_id AS id, CAST(len({WORDS}) AS INTEGER) AS n_words, md5(array_to_string({WORDS}, '|')) AS words FROM documents")
def text_split_words(spark, d):
    w = text.split_words(text.basic_clean(F.col("text")))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.size(w).alias("n_words"), F.md5(F.concat_ws("|", w).cast("binary")).alias("words"))


SMALL = {text.START: 49406, text.STOP: 49407, text.PAD: 0, "e": 1, "e</w>": 2, "t": 3, "n</w>": 4, "the": 5, "of": 6, "and": 7}
ID_OF = "CASE t " + " ".join(f"WHEN '{t}' THEN {i}" for t, i in SMALL.items()) + " ELSE 0 END"


@query(f"SELECT doc_id AS id, CAST(list_sum(list_transform({WORDS}, lambda t: {ID_OF})) AS BIGINT) AS id_sum FROM documents")
def token_lookup(spark, d):
    ids = tokenizer.token_ids(text.split_words(text.basic_clean(F.col("text"))), SMALL)
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.aggregate(ids, F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"))


@query(f"WITH w AS (SELECT doc_id AS id, {WORDS} AS w FROM documents) SELECT id, CAST(CASE WHEN len(w) > 1 THEN len(list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))) ELSE 0 END AS INTEGER) AS n_pairs FROM w")
def token_bigrams(spark, d):
    w = text.split_words(text.basic_clean(F.col("text")))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.size(text.bigrams(w)).alias("n_pairs"))


BODY = f"flatten(list_transform({WORDS}, lambda w: list_transform(generate_series(1, length(w)), lambda i: substr(w, i, 1) || CASE WHEN i = length(w) THEN '</w>' ELSE '' END)))"
TOKENS = f"list_concat(['{text.START}'], list_concat({BODY}, ['{text.STOP}']))"


def prompt_tokens(spark, d) -> DataFrame:
    body = tokenizer.encode_words(text.split_words(text.basic_clean(F.col("text"))), {})
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), text.with_markers(body).alias("t"))


@query(f"WITH t AS (SELECT doc_id AS id, {TOKENS} AS t FROM documents) SELECT id, CAST(greatest(len(t), 77) AS INTEGER) AS n, CAST(greatest(77 - len(t), 0) AS INTEGER) AS pads FROM t")
def tokenize_min_count(spark, d):
    padded = text.pad_to(F.col("t"), 77)
    return prompt_tokens(spark, d).select("id", F.size(padded).alias("n"), F.size(F.filter(padded, lambda x: x == text.PAD)).alias("pads"))


@query(
    f"WITH t AS (SELECT doc_id AS id, {TOKENS} AS t FROM documents), f AS (SELECT id, CASE WHEN len(t) > 77 THEN list_concat(t[1:76], ['{text.STOP}']) ELSE list_resize(t, 77, '{text.PAD}') END AS f FROM t) "
    f"SELECT id, CAST(len(f) AS INTEGER) AS n, md5(array_to_string(list_transform(f, lambda t: {ID_OF}), ',')) AS ids FROM f"
)
def tokenize_fixed_context(spark, d):
    tokenizer.require_specials(SMALL)
    # a word is a token at least, so words beyond the context cannot reach it
    words = F.slice(text.split_words(text.basic_clean(F.col("text"))), 1, 77)
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), text.with_markers(tokenizer.encode_words(words, {})).alias("t"))
    f = t.select("id", text.fixed_context(F.col("t"), 77).alias("f"))
    ids = F.transform(tokenizer.token_ids(F.col("f"), SMALL), lambda x: x.cast("string"))
    return f.select("id", F.size("f").alias("n"), F.md5(F.concat_ws(",", ids).cast("binary")).alias("ids"))


@query(f"WITH t AS (SELECT item_id AS id, {TOKENS} AS t FROM benchmark) SELECT id, md5(replace(replace(replace(array_to_string(t, ''), '</w>', ' '), '{text.START}', ''), '{text.STOP}', '')) AS decoded FROM t")
def token_decode(spark, d):
    body = tokenizer.encode_words(text.split_words(text.basic_clean(F.col("text"))), {})
    t = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), text.with_markers(body).alias("t"))
    return t.select("id", F.md5(text.decode(F.col("t")).cast("binary")).alias("decoded"))


MERGES = ["t h", "th e</w>", "i n", "e r", "a n", "an d</w>"]
# in SQL a token stands between two marks, and merges whose parts are older apply one after another
MARKED = f"array_to_string(list_transform({BODY}, lambda t: chr(1) || t || chr(2)), '')"
for _a, _b in (m.split() for m in MERGES):
    MARKED = f"replace({MARKED}, chr(1) || '{_a}' || chr(2) || chr(1) || '{_b}' || chr(2), chr(1) || '{_a}{_b}' || chr(2))"


@query(f"WITH m AS (SELECT item_id AS id, {MARKED} AS m FROM benchmark) SELECT id, CAST(length(m) - length(replace(m, chr(1), '')) AS INTEGER) AS n, replace(replace(replace(m, chr(2) || chr(1), ' '), chr(1), ''), chr(2), '') AS tokens FROM m")
def bpe_encode(spark, d):
    ranks = tokenizer.read_merges(["#version", *MERGES])
    w = tokenizer.encode_words(text.split_words(text.basic_clean(F.col("text"))), ranks)
    return table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.size(w).alias("n"), F.concat_ws(" ", w).alias("tokens"))


@query(f"SELECT item_id AS id, {CLEAN} = {CLEAN} AS same FROM benchmark")
def token_exact_match(spark, d):
    w = text.split_words(text.basic_clean(F.col("text")))
    letters = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, i, F.lit(1)), F.when(i == F.length(x), text.WORD_END).otherwise("")))
    t = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), tokenizer.encode_words(w, {}).alias("actual"), F.flatten(F.transform(w, letters)).alias("expected"))
    ids = tokenizer.lookup_ids(F.col("actual"), SMALL) == tokenizer.token_ids(F.col("expected"), SMALL)
    return t.select("id", ((F.col("actual") == F.col("expected")) & ids).alias("same"))


# contracts


@query("SELECT * FROM (VALUES ('mobileclip2-s4', '7e54cbc768d58ae82c1e2c11e3347e489bffea88b6495fc020602101f17016fb'), ('mobileclip-s2', '024f7ba92c845bdc151d20320b16fb79932658af4ca71685fe56cfe4216351ec')) t(model_id, identity)")
def model_identity(spark, d):
    rows = spark.createDataFrame([(s.model_id, s.components()) for s in (spec.S4, spec.S2)], "model_id string, parts array<string>")
    joined = F.concat_ws("", F.transform("parts", lambda p: F.concat(F.octet_length(p).cast("string"), F.lit(":"), p)))
    return rows.select("model_id", F.sha2(joined.cast("binary"), 256).alias("identity"))


@query()
def checkpoint_hash(spark, d):
    place = Path(tempfile.mkdtemp(prefix="vecloom-artifacts-"))
    for name in spec.S4.artifacts():
        (place / name).write_text(name)
    h = spec.S4.checkpoint_hash(str(place))
    return one(spark, checkpoint=h, adoption=spec.S4.adoption_id(h))


@query("SELECT * FROM (VALUES ('good', true), ('blank id', false), ('bad id', false), ('no size', false), ('no dimension', false), ('text input', false), ('bad scalar', false), ('one asset', false), ('path', false)) t(spec, valid)")
def spec_validation(spark, d):
    from dataclasses import replace

    cases = {"good": {}, "blank id": {"model_id": " "}, "bad id": {"model_id": "a b"}, "no size": {"image_size": 0}, "no dimension": {"dimension": 0}, "text input": {"image_input_type": "multiArrayInt32"}, "bad scalar": {"storage": "float64"}, "one asset": {"tokenizer_assets": ("v",)}, "path": {"image_model": "a/b"}}
    return spark.createDataFrame([(n, not replace(spec.S4, **c).problems()) for n, c in cases.items()], "spec string, valid boolean")


@query("SELECT * FROM (VALUES ('mobileclip-s2', NULL, true), ('mobileclip-s2', 'mobileclip-s2-v1', true), ('mobileclip-s2', 'v9', false), ('other', NULL, false)) t(model_id, revision, found)")
def registry_lookup(spark, d):
    r = spec.Registry()
    r.register(spec.S2)
    r.register(spec.S4)
    asked = [("mobileclip-s2", None), ("mobileclip-s2", "mobileclip-s2-v1"), ("mobileclip-s2", "v9"), ("other", None)]
    return spark.createDataFrame([(m, v, r.find(m, v) is not None) for m, v in asked], "model_id string, revision string, found boolean")


@query("SELECT * FROM (VALUES ('merges.txt')) t(artifact)")
def missing_artifacts(spark, d):
    place = Path(tempfile.mkdtemp(prefix="vecloom-artifacts-"))
    for name in spec.S4.artifacts()[:-1]:
        (place / name).touch()
    return spark.createDataFrame([(a,) for a in spec.S4.missing_artifacts(str(place))], "artifact string")


@query("SELECT doc_id AS id, length(text) > 0 AND strlen(text) <= 65535 AND NOT contains(text, chr(10)) AS valid FROM documents")
def id_validation(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), text.valid_id(F.col("text")).alias("valid"))


# ranks, parity, benchmarks


@query(f"{SCORED} SELECT id, row_number() OVER (PARTITION BY label ORDER BY score DESC, id) - 1 AS place FROM s")
def ranks_desc(spark, d):
    rows = index(spark, d)
    s = rows.crossJoin(F.broadcast(rows.where("id = 0").select(vector.unit_double(F.col("embedding")).alias("q")))).select("id", "label", vector.cosine_to_unit(F.col("embedding"), F.col("q")).alias("score"))
    return s.select("id", ranking.rank_unique("score", "id", ["label"]).alias("place"))


@query("SELECT event_id AS id, rank() OVER (PARTITION BY event_type ORDER BY floor(value) DESC) - 1 + (count(*) OVER (PARTITION BY event_type, floor(value)) - 1) / 2.0::DOUBLE AS place FROM events")
def ranks_average(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), "event_type", F.floor("value").alias("v"))
    return e.select("id", ranking.rank_average("v", ["event_type"]).alias("place"))


RANK_OF = "rank() OVER (PARTITION BY event_type ORDER BY {0} DESC) + (count(*) OVER (PARTITION BY event_type, {0}) - 1) / 2.0::DOUBLE"


@query(f"SELECT event_type, round(corr(a, b), 9) AS rank_correlation FROM (SELECT event_type, {RANK_OF.format('floor(value)')} AS a, {RANK_OF.format('(user_id % 97)')} AS b FROM events) GROUP BY 1")
def spearman(spark, d):
    e = table(spark, d, "events").select("event_type", F.floor("value").alias("a"), (F.col("user_id") % 97).alias("b"))
    return ranking.spearman(e, "a", "b", ["event_type"]).select("event_type", F.round("rank_correlation", 9).alias("rank_correlation"))


HALVED = f"SELECT vec_id AS id, CASE WHEN label % 2 = 0 THEN 'image' ELSE 'text' END AS kind, embedding AS a, list_transform(embedding, lambda e: CAST({HALF.replace('x', 'e::DOUBLE')} AS FLOAT)) AS b FROM embeddings"
GATED = f"WITH p AS (SELECT *, {NORM.format('a')} AS na, {NORM.format('b')} AS nb FROM ({HALVED})), g AS (SELECT id, kind, a, b, na, nb, CAST(1::FLOAT - {RAW} AS FLOAT) AS cosine_distance FROM p)"
FAILS = "concat_ws(',', CASE WHEN abs(na::FLOAT - 1) > 1e-3::FLOAT THEN 'vector-validation' END, CASE WHEN cosine_distance > 1e-4::FLOAT THEN 'cosine-distance' END, CASE WHEN abs(nb::FLOAT - 1) > 1e-3::FLOAT THEN 'candidate-norm' END"


def fixtures(spark, d) -> DataFrame:
    kind = F.when(F.col("label") % 2 == 0, "image").otherwise("text")
    return index(spark, d).select("id", kind.alias("kind"), F.col("embedding").alias("reference"), vector.to_half(F.col("embedding")).alias("candidate"))


@query(f"{GATED} SELECT id, kind, round(cosine_distance::DOUBLE, 6) AS cosine_distance, {FAILS}) AS failures FROM g")
def parity_pair_gate(spark, d):
    g = parity.pair_gate(fixtures(spark, d))
    return g.select("id", "kind", F.round(F.col("cosine_distance").cast("double"), 6).alias("cosine_distance"), F.concat_ws(",", "failures").alias("failures"))


@query(
    f"{GATED}, c AS (SELECT g.id, g.kind, g.cosine_distance, g.na, g.nb, CAST({DOT.format('g.a', 'g.a[i]::DOUBLE * h.a[i]::DOUBLE')} / (g.na * h.na) AS FLOAT) AS x, CAST({DOT.format('g.b', 'g.b[i]::DOUBLE * h.b[i]::DOUBLE')} / (g.nb * h.nb) AS FLOAT) AS y FROM g JOIN g h ON g.kind <> h.kind), "
    "r AS (SELECT id, rank() OVER (PARTITION BY id ORDER BY x DESC) + (count(*) OVER (PARTITION BY id, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY id ORDER BY y DESC) + (count(*) OVER (PARTITION BY id, y) - 1) / 2.0::DOUBLE AS ry FROM c), "
    f"k AS (SELECT id, round(corr(rx, ry), 9) AS rank_correlation FROM r GROUP BY 1), f AS (SELECT id, kind, rank_correlation, {FAILS}, CASE WHEN rank_correlation IS NULL OR rank_correlation < 0.999 THEN 'rank-correlation' END) AS failures FROM g JOIN k USING (id)) "
    "SELECT id, kind, round(rank_correlation, 6) AS rank_correlation, failures, failures = '' AS passed FROM f"
)
def parity_fixture_gate(spark, d):
    f = fixtures(spark, d)
    g = parity.fixture_gate(f.select("id", "kind", F.col("reference").alias("vector")), f.select("id", F.col("candidate").alias("vector")))
    return g.select("id", "kind", F.round("rank_correlation", 6).alias("rank_correlation"), F.concat_ws(",", "failures").alias("failures"), "passed")


def samples(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("metric"), (F.col("user_id") % 3).alias("run"), F.col("value").alias("ms"))


SAMPLES = "SELECT event_type AS metric, user_id % 3 AS run, value AS ms FROM events"


@query(f"SELECT metric, run, count(ms) AS n, round(avg(ms), 6) AS mean, min(ms) AS least, max(ms) AS most, round(stddev_pop(ms), 6) AS deviation, round(median(ms), 6) AS median, quantile_disc(ms, 0.95) AS p95, round(count(ms) * 1000.0::DOUBLE / sum(ms), 6) AS per_second FROM ({SAMPLES}) GROUP BY 1, 2")
def bench_run_stats(spark, d):
    return benchmarks.run_stats(samples(spark, d), ["metric", "run"])


CROSS = f"WITH s AS ({SAMPLES}), r AS (SELECT metric, run, median(ms) AS m, count(ms) * 1000.0::DOUBLE / sum(ms) AS t FROM s GROUP BY 1, 2), a AS (SELECT metric, round(median(m), 6) AS median, round(median(t), 6) AS per_second, count(*) AS runs FROM r GROUP BY 1)"


@query(f"{CROSS} SELECT a.*, p95 FROM a JOIN (SELECT metric, quantile_disc(ms, 0.95) AS p95 FROM s GROUP BY 1) USING (metric)")
def bench_cross_run(spark, d):
    return benchmarks.cross_run(samples(spark, d))


@query(f"{CROSS}, b AS (SELECT metric, median, median * CASE WHEN length(metric) > 5 THEN 1.16::DOUBLE ELSE 1.14::DOUBLE END AS slower FROM a) SELECT metric, round(100 * (slower / median - 1), 6) AS change_percent, round(100 * (slower / median - 1), 6) > 15 AS regression FROM b")
def bench_compare(spark, d):
    base = benchmarks.cross_run(samples(spark, d)).select("metric", "median")
    slower = base.select("metric", (F.col("median") * F.when(F.length("metric") > 5, 1.16).otherwise(1.14)).alias("median"))
    return benchmarks.compare(base, slower, 15)


@query("SELECT * FROM (VALUES ('search_1000', 'missing'), ('views', 'unknown')) t(metric, problem)")
def bench_required_metrics(spark, d):
    need = benchmarks.required_metrics(benchmarks.workload(sizes=(1000,))["indexSizes"])
    rows = lambda names: spark.createDataFrame([(n,) for n in names], "metric string")
    return benchmarks.missing_metrics(rows([n for n in need if n != "search_1000"] + ["views"]), rows(need))


@query("SELECT * FROM (VALUES ('faster', 'search -50.0 false'), ('slower', 'search +20.0 true'), ('just over', 'search +15.0 true'), ('other machine', 'notComparable'), ('other metrics', 'metricsDiffer'), ('zero time', 'invalidTiming'), ('hot', 'thermalPressure'), ('unfinished', 'incompleteReport')) t(report, outcome)")
def bench_report_rules(spark, d):
    """Reports that may not be compared are refused by name; the limit holds before rounding."""

    def report(ms=10.0, metric="search", **more):
        return {"schema": 1, "status": "complete", "key": {"hardware": "a"}, "thermalStates": ["nominal"], "metrics": {metric: {"samples": [ms]}}, **more}

    cases = {"faster": report(5.0), "slower": report(12.0), "just over": report(11.5000000004), "other machine": report(key={"hardware": "b"}), "other metrics": report(metric="views"), "zero time": report(0.0), "hot": report(thermalStates=["serious"]), "unfinished": report(status="running")}
    out = []
    for name, r in cases.items():
        try:
            x = benchmarks.compare_reports(spark, report(), r, ["search"], 15).first()
            out.append((name, f"{x['metric']} {x['change_percent']:+.1f} {str(x['regression']).lower()}"))
        except EngineError as e:
            out.append((name, e.code))
    return spark.createDataFrame(out, "report string, outcome string")


@query(f"{CROSS} SELECT '| ' || metric || ' | +20.0 % | slower |' AS line FROM a UNION ALL SELECT * FROM (VALUES ('| metric | change | verdict |'), ('|-|-|-|'))")
def bench_report_written(spark, d):
    base = benchmarks.cross_run(samples(spark, d)).select("metric", "median")
    place = Scratch(spark, "report").root
    benchmarks.write_report(benchmarks.compare(base, base.withColumn("median", F.col("median") * 1.2), 15), place)
    return spark.read.text(f"{place}/summary").select(F.col("value").alias("line"))


@query("SELECT * FROM (VALUES ('sound', 'invalidTransition', true), ('damaged', 'set aside', false), ('other version', 'set aside', false)) t(state, outcome, active)")
def coordinator_quarantine(spark, d):
    """Only a state that cannot be read is set aside."""
    out = []
    for name in ("sound", "damaged", "other version"):
        folder = local_folder(spark)
        c = coordinator.Coordinator(folder)
        c.adopt(coordinator.Reference("m", "i", "h", "g0"))
        if name == "damaged":
            c.path.write_bytes(c.path.read_bytes()[:-9])
        if name == "other version":
            c.path.write_bytes(durable.seal(durable.unseal(c.path.read_bytes()) | {"version": 2}))
        try:
            coordinator.Coordinator.quarantine(folder)
            outcome = "set aside"
        except EngineError as e:
            outcome = e.code
        out.append((name, outcome, coordinator.Coordinator(folder).state.active is not None))
    return spark.createDataFrame(out, "state string, outcome string, active boolean")


@query("SELECT array_to_string(list_sort(list(DISTINCT event_type)), ',') AS states FROM events")
def bench_state_set(spark, d):
    return table(spark, d, "events").agg(F.concat_ws(",", F.sort_array(F.collect_set("event_type"))).alias("states"))


@query("SELECT round(median(peak), 6) AS peak FROM (SELECT user_id % 3 AS run, max(value) AS peak FROM events GROUP BY 1)")
def bench_memory_median(spark, d):
    return samples(spark, d).groupBy("run").agg(F.max("ms").alias("peak")).agg(F.round(F.median("peak"), 6).alias("peak"))


@query()
def fixture_json_roundtrip(spark, d):
    scratch = Scratch(spark, "fixture")
    cases = [{"id": "empty", "prompt": "", "paddedLength": 77, "expectedTokenIDs": [49406, 49407]}, {"id": "unpadded", "prompt": "cat", "paddedLength": None, "expectedTokenIDs": [49406, 2368, 49407]}]
    body = json.dumps({"manifest": {"fixtureVersion": "1", "modelID": "m", "contextLength": 77}, "cases": cases}, indent=1)
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.text(scratch.path("fixture"))
    read = spark.read.schema(TOKEN_FIXTURE).option("multiLine", True).json(scratch.path("fixture"))
    return read.select(F.explode("cases").alias("c")).select("c.id", "c.prompt", "c.paddedLength", F.concat_ws(",", F.transform("c.expectedTokenIDs", lambda x: x.cast("string"))).alias("ids"))


@query(
    "WITH RECURSIVE g(k, s) AS (SELECT 0, 5860666710079652428::UHUGEINT UNION ALL SELECT k + 1, (s * 6364136223846793005::UHUGEINT + 1442695040888963407::UHUGEINT) % 18446744073709551616::UHUGEINT FROM g WHERE k < 512) "
    "SELECT 'synthetic-' || CAST((k - 1) // 8 AS VARCHAR) AS id, round(sum(CAST((s // 1099511627776::UHUGEINT) AS DOUBLE) / 16777216 - 0.5), 6) AS total FROM g WHERE k > 0 GROUP BY 1"
)
def lcg_vectors(spark, d):
    v = generators.synthetic_vectors(spark, 64, 8, 3)
    return v.select("id", F.round(vector.total(F.transform("embedding", lambda x: x.cast("double"))), 6).alias("total"))


@query("SELECT vec_id AS id, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings")
def segment_binary_roundtrip(spark, d):
    from vecloom.sources.segment_source import SegmentSource

    folder = local_folder(spark)
    rows = index(spark, d).select(F.col("id").cast("string").alias("id"), "embedding")
    ship(spark)
    spark.dataSource.register(SegmentSource)
    rows.write.format("vector_segment").option("path", folder).option("dimension", D).mode("append").save()
    read = spark.read.format("vector_segment").option("path", folder).option("dimension", D).load()
    return read.select(F.col("id").cast("long").alias("id"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query()
def coordinator_transitions(spark, d):
    c = coordinator.Coordinator(local_folder(spark))
    out = []

    def step(name, f):
        try:
            f()
            result = "ok"
        except EngineError as e:
            result = e.code
        out.append((len(out), name, result, c.state.phase, c.state.revision))

    step("adopt", lambda: c.adopt(coordinator.Reference("m", "i", "h", "g0")))
    first = []
    step("request", lambda: first.append(c.request("m2", "i2", "h2")))
    step("activate incomplete", lambda: c.activate(first[0], 1, False))
    step("activate revision 0", lambda: c.activate(first[0], 0, True))
    step("cancel", lambda: c.cancel(first[0]))
    step("request again", lambda: first.append(c.request("m2", "i2", "h2")))
    step("activate stale", lambda: c.activate(first[0], 1, True))
    step("activate", lambda: c.activate(first[1], 1, True))
    step("rollback", c.rollback)
    return spark.createDataFrame(out, "step int, action string, result string, phase string, revision long")


@query("SELECT * FROM (VALUES ('beforeWrite', false), ('written', false), ('afterRename', true), ('synced', true), ('done', true)) t(boundary, committed)")
def coordinator_recovery(spark, d):
    out = []
    for boundary in coordinator.BOUNDARIES:
        folder = local_folder(spark)
        c = coordinator.Coordinator(folder)
        c.adopt(coordinator.Reference("m", "i", "h", "g0"))

        def fault(at, boundary=boundary):
            if at == boundary:
                raise EngineError("crash", at)

        c.fault = fault
        try:
            c.request("m2", "i2", "h2")
        except EngineError:
            pass
        out.append((boundary, coordinator.Coordinator(folder).state.requested is not None))
    return spark.createDataFrame(out, "boundary string, committed boolean")


@query("SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS position FROM documents")
def library_ordered_scan(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    return ordering.positions(rows, [F.col("n_chars").desc(), F.col("id")]).select("id", "position")


@query("SELECT doc_id AS id FROM documents WHERE source = 'src3' ORDER BY doc_id LIMIT 1")
def library_album_by_title(spark, d):
    return table(spark, d, "documents").where("source = 'src3'").select(F.col("doc_id").alias("id")).orderBy("id").limit(1)


@query("SELECT d.doc_id AS id FROM documents d WHERE d.doc_id IN (SELECT vec_id FROM embeddings)")
def library_batch_lookup(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id")).join(index(spark, d).select("id"), "id", "left_semi")


@query("SELECT md5(string_agg(event_type, ',' ORDER BY event_type)) AS digest FROM (SELECT DISTINCT event_type FROM events)")
def manifest_seal(spark, d):
    names = sorted(r[0] for r in table(spark, d, "events").select("event_type").distinct().collect())
    opened = durable.unseal(durable.seal({"states": names}))
    return one(spark, digest=hashlib.md5(",".join(opened["states"]).encode()).hexdigest())


@query("SELECT sha256(string_agg(CAST(item_id AS VARCHAR) || ':' || sha256(text), chr(10) ORDER BY CAST(item_id AS VARCHAR))) AS fingerprint FROM benchmark")
def bench_source_fingerprint(spark, d):
    return benchmarks.source_fingerprint(table(spark, d, "benchmark").select(F.col("item_id").alias("name"), F.col("text").cast("binary").alias("content")))


MEDIA = "SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'add' WHEN 'purchase' THEN 'remove' WHEN 'error' THEN 'delete' ELSE 'removeAll' END AS op, 'src' || CAST(event_id % 4 AS VARCHAR) AS album, event_id % 500 AS id FROM events WHERE event_type IN ('signup', 'purchase', 'error') OR event_id % 997 = 0"


@query(
    f"WITH c AS ({MEDIA}), a AS (SELECT -1 AS seq, source AS album, doc_id AS id FROM documents WHERE source IS NOT NULL UNION ALL SELECT seq, album, id FROM c WHERE op = 'add') "
    "SELECT DISTINCT album, id FROM a WHERE NOT EXISTS (SELECT 1 FROM c WHERE op = 'remove' AND c.album = a.album AND c.id = a.id AND c.seq > a.seq) "
    "AND NOT EXISTS (SELECT 1 FROM c WHERE op = 'removeAll' AND c.album = a.album AND c.seq > a.seq) AND NOT EXISTS (SELECT 1 FROM c WHERE op = 'delete' AND c.id = a.id AND c.seq > a.seq)"
)
def library_album_changes(spark, d):
    e = table(spark, d, "events")
    op = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "purchase", "remove").when(F.col("event_type") == "error", "delete").when(F.col("event_id") % 997 == 0, "removeAll")
    album = F.concat(F.lit("src"), (F.col("event_id") % 4).cast("string"))
    log = e.select(F.col("event_id").alias("seq"), op.alias("op"), album.alias("album"), (F.col("event_id") % 500).alias("id")).where("op IS NOT NULL")
    now = table(spark, d, "documents").select(F.col("source").alias("album"), F.col("doc_id").alias("id"))
    known = spark.createDataFrame([(f"src{k}",) for k in range(4)], "album string")
    return media.members(now, known, log)


@query(
    "WITH f AS (SELECT event_id % 500 AS id, arg_max(event_type, event_id) AS op FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY 1) "
    "SELECT doc_id AS id, coalesce(op = 'signup', false) AS favourite FROM documents LEFT JOIN f ON id = doc_id WHERE doc_id NOT IN (SELECT event_id % 500 FROM events WHERE event_type = 'error' AND event_id % 3 = 0)"
)
def library_favourites(spark, d):
    e = table(spark, d, "events")
    op = F.when(F.col("event_type") == "signup", "favour").when(F.col("event_type") == "purchase", "unfavour").when((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0), "delete")
    log = e.select(F.col("event_id").alias("seq"), op.alias("op"), (F.col("event_id") % 500).alias("id")).where("op IS NOT NULL")
    return media.favourites(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit(False).alias("favourite")), log)


@query("SELECT vec_id AS id, vec_id % 20 < 12 AND label % 3 < 2 AS cpu_only FROM embeddings")
def device_policy(spark, d):
    family = F.element_at(F.array(F.lit("iPhone"), F.lit("iPad"), F.lit("Watch")), (F.col("label") % 3 + 1).cast("int"))
    return index(spark, d).select("id", media.cpu_only(F.concat(family, (F.col("id") % 20).cast("string"), F.lit(",1"))).alias("cpu_only"))


@query("SELECT event_id AS id, value < 0 OR event_type IN ('error', 'view') AS paused, event_id % 500 < 100 AS rests FROM events WHERE value IS NOT NULL")
def indexing_throttle(spark, d):
    heat = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "view", "serious").otherwise("fair")
    rows = table(spark, d, "events").where("value IS NOT NULL")
    return rows.select(F.col("event_id").alias("id"), media.paused(F.col("value") < 0, heat).alias("paused"), media.rests(F.col("event_id")).alias("rests"))


@query("SELECT user_id, event_type FROM events WHERE value >= 0 GROUP BY 1, 2")
def stream_first_final(spark, d):
    """Each request is answered once, however many batches repeat it."""
    from vecloom.streaming import answers

    scratch = Scratch(spark, "answers")
    log = table(spark, d, "events").select("user_id", "event_type", "value", "event_id")
    log.repartitionByRange(3, "event_id").write.parquet(scratch.path("changes"))
    source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(scratch.path("changes"))
    first = answers.first_final(source, ["user_id", "event_type"], "value >= 0").select("user_id", "event_type")
    answers.run(first, scratch.path("out"), scratch.path("offsets")).awaitTermination()
    return spark.read.schema(first.schema).parquet(scratch.path("out"))


@query("SELECT * FROM (VALUES ('never written', false), ('written', true), ('other contract', false), ('emptied', false)) t(state, loaded)")
def store_load_or_none(spark, d):
    place = store_folder(spark)
    s = store.VectorStore(spark, place, "m", "g1", D)
    out = [("never written", s.load_or_none() is not None)]
    rows = named(index(spark, d).where("id < 3"))
    s.commit(upserts=rows)
    out.append(("written", s.load_or_none() is not None))
    out.append(("other contract", store.VectorStore(spark, place, "m", "g1", D + 1).load_or_none() is not None))
    s.commit(deletes=rows.select("id"))
    out.append(("emptied", s.load_or_none() is not None))
    return spark.createDataFrame(out, "state string, loaded boolean")
