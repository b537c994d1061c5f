"""A crash-safe, versioned vector store: Parquet segments under one checksummed manifest.

A commit writes its rows as Parquet once, checks the rows that were written, has tasks digest the files, then
swaps the manifest; the rename of the manifest is the one moment from which readers see it. Readers follow the
manifest only, so whatever else lies in the folder is harmless and goes at the next commit. The folder can be
on any file system that Spark reads and whose rename is one step; the driver itself reads only the manifest.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions import text, vector
from vecloom.operators import store_log
from vecloom.sources.durable import seal, unseal
from vecloom.sources.files import Files
from vecloom.types import COMPACT_OVER, EngineError

BOUNDARIES = ("segmentWritten", "segmentSynced", "segmentVerified", "segmentFolderSynced", "manifestWritten", "manifestRenamed", "directorySynced", "cleanupFinished")
LOG = "seq long, op string, id string, embedding array<float>"


class VectorStore:
    def __init__(self, spark: SparkSession, root: str, identity: str, generation: str, dimension: int, storage: str = "float32", normalization: str = "l2", fault=None):
        self.spark, self.identity, self.generation, self.dimension = spark, identity, generation, dimension
        self.storage, self.normalization, self.fault = storage, normalization, fault or (lambda at: None)
        self.files = Files(spark)
        self.folder = f"{root.rstrip('/')}/{hashlib.sha256(identity.encode()).hexdigest()[:16]}/{generation}"
        self.segments, self.new, self.manifest_path = (f"{self.folder}/{x}" for x in ("segments", "new", "manifest.json"))

    # reading

    def manifest(self) -> dict | None:
        """None if the store was never written; errors for another contract or damaged files."""
        if not self.files.exists(self.manifest_path):
            if self.files.names(self.segments) and not self.files.exists(self.new):
                raise EngineError("corrupt", "segments without a manifest")
            return None
        m = unseal(self.files.read(self.manifest_path))
        if m.get("identity") != self.identity or m.get("dimension") != self.dimension:
            raise EngineError("incompatible")
        if m.get("generation") != self.generation:
            raise EngineError("staleGeneration")
        return m

    def load(self, verify: bool = True) -> tuple[DataFrame, dict] | None:
        """(live rows id, embedding; manifest), or None if missing."""
        m = self.manifest()
        if m is None:
            return None
        here = set(self.files.names(self.segments))
        lost = [s["name"] for s in m["segments"] if s["name"] not in here]
        if lost:
            raise EngineError("corrupt", lost[0])
        if verify:
            now = self.files.digests([f"{self.segments}/{s['name']}" for s in m["segments"]])
            for s in m["segments"]:
                if now[s["name"]] != s["digest"]:
                    raise EngineError("corrupt", s["name"])
        log = None
        for k, s in enumerate(m["segments"]):
            rows = self.spark.read.schema("op string, id string, embedding array<float>").parquet(f"{self.segments}/{s['name']}")
            rows = rows.withColumn("seq", F.lit(2 * k) + (F.col("op") == "U").cast("long"))
            log = rows if log is None else log.unionByName(rows)
        if log is None:
            log = self.spark.createDataFrame([], LOG)
        return store_log.replay(log), m

    def load_or_none(self) -> DataFrame | None:
        """Live rows, or None if there are none or the store cannot be read."""
        try:
            loaded = self.load()
        except EngineError:
            return None
        return None if loaded is None or loaded[0].isEmpty() else loaded[0]

    def needs_compaction(self) -> bool:
        m = self.manifest()
        return m is not None and len(m["segments"]) > COMPACT_OVER

    # writing

    def _stored(self, rows: DataFrame) -> DataFrame:
        v = F.col("embedding")
        if self.normalization == "l2":
            v = vector.normalize(v)
        if self.storage == "float16":
            v = vector.to_half(v)
        bad = ~text.valid_id(F.col("id")) | F.col("embedding").isNull() | (F.size("embedding") != self.dimension)
        shaped = rows.select("id", v.alias("embedding"), bad.alias("bad"))
        return shaped.withColumn("bad", F.col("bad") | F.exists("embedding", lambda x: x.isNull() | ~vector.is_finite(x)))

    def commit(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None, checkpoint: dict | None = None, replacing: bool = False, expect: int | None = None) -> int:
        """Deletes first, then upserts, visible together or not at all; the new revision. A checkpoint stays unless a new one is given."""
        old = self.manifest()
        revision = old["revision"] if old else 0
        if expect is not None and expect != revision:
            raise EngineError("staleRevision", f"{revision}, not {expect}")
        parts = []
        if deletes is not None:
            parts.append(deletes.select(F.lit("D").alias("op"), "id", F.lit(None).cast("array<float>").alias("embedding"), F.lit(False).alias("bad")))
        if upserts is not None:
            parts.append(self._stored(upserts).select(F.lit("U").alias("op"), "id", "embedding", F.coalesce("bad", F.lit(True)).alias("bad")))
        segments = [] if replacing or not old else list(old["segments"])
        self.files.make(self.segments)
        if parts:
            rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
            name = uuid.uuid4().hex
            place = f"{self.segments}/{name}"
            self.files.write(self.new, b"")
            # the rows are made once, and those that were written are the ones checked
            rows.sortWithinPartitions("id").write.parquet(place)
            self.fault("segmentWritten")
            self.files.sync(place)
            self.fault("segmentSynced")
            put = F.col("op") == "U"
            saved = self.spark.read.schema("op string, id string, embedding array<float>, bad boolean").parquet(place)
            check = saved.agg(F.count_if("bad").alias("bad"), F.count_if(put).alias("n"), F.count_distinct(F.when(put, F.col("id"))).alias("ids"), F.count(F.lit(1)).alias("rows")).first()
            if check["bad"] or check["n"] != check["ids"]:
                self.files.delete(place)
                raise EngineError("invalidRecord", f"{check['bad']} rows") if check["bad"] else EngineError("duplicateID")
            segments.append({"name": name, "digest": self.files.digests([place])[name], "count": check["rows"]})
            self.fault("segmentVerified")
            self.files.sync(self.segments)
            self.fault("segmentFolderSynced")
        m = {"version": 1, "identity": self.identity, "dimension": self.dimension, "generation": self.generation, "revision": revision + 1, "segments": segments, "checkpoint": checkpoint if checkpoint is not None else (old or {}).get("checkpoint")}
        self.files.write(f"{self.manifest_path}.tmp", seal(m))
        self.fault("manifestWritten")
        self.files.move(f"{self.manifest_path}.tmp", self.manifest_path)
        self.fault("manifestRenamed")
        self.files.sync(self.folder)
        self.fault("directorySynced")
        self.collect_garbage(m)
        self.fault("cleanupFinished")
        return revision + 1

    def collect_garbage(self, m: dict) -> None:
        """Delete what no manifest names; best effort."""
        live = {s["name"] for s in m["segments"]}
        self.files.delete(self.new)
        for name in self.files.names(self.segments):
            if name not in live:
                self.files.delete(f"{self.segments}/{name}")

    def compact(self) -> int:
        """One segment of the live rows; checkpoint and content stay."""
        rows, m = self.load()
        return self.commit(upserts=rows, replacing=True, expect=m["revision"])
