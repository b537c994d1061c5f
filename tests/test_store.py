from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.sources import binary_format, coordinator, durable, spec
from vecloom.sources.store import BOUNDARIES, VectorStore
from vecloom.types import EngineError

UP = "id string, embedding array<float>"


def make(spark, root, **more):
    return VectorStore(spark, str(root), "identity", "g1", 2, normalization="none", **more)


def ids(store):
    return sorted(r["id"] for r in store.load()[0].collect())


def test_replace_delete_compact(spark, tmp_path):
    s = make(spark, tmp_path)
    assert s.load() is None
    s.commit(upserts=spark.createDataFrame([("one", [1.0, 0.0]), ("two", [1.0, 0.0])], UP))
    s.commit(upserts=spark.createDataFrame([("one", [-1.0, 0.0]), ("three", [1.0, 0.0])], UP), checkpoint={"k": 1})
    s.commit(deletes=spark.createDataFrame([("two",), ("unknown",)], "id string"))
    live = {r["id"]: r["embedding"][0] for r in s.load()[0].collect()}
    assert live == {"one": -1.0, "three": 1.0}
    assert s.compact() == 4
    rows, m = s.load()
    assert sorted(r["id"] for r in rows.collect()) == ["one", "three"] and len(m["segments"]) == 1 and m["checkpoint"] == {"k": 1}


def test_deletes_come_first_in_a_commit(spark, tmp_path):
    s = make(spark, tmp_path)
    row = spark.createDataFrame([("one", [1.0, 0.0])], UP)
    s.commit(upserts=row, deletes=row.select("id"))
    assert ids(s) == ["one"]


def test_missing_is_not_empty_incompatible_or_corrupt(spark, tmp_path):
    s = make(spark, tmp_path)
    s.commit()
    assert s.load()[0].count() == 0
    with pytest.raises(EngineError, match="staleRevision"):
        s.commit(expect=7)
    other = VectorStore(spark, str(tmp_path), "identity", "g1", 3)
    with pytest.raises(EngineError, match="incompatible"):
        other.load()
    s.commit(upserts=spark.createDataFrame([("one", [1.0, 0.0])], UP))
    part = next(Path(s.folder).glob("segments/*/*.parquet"))
    part.write_bytes(part.read_bytes()[:-1] + b"x")
    with pytest.raises(EngineError, match="corrupt"):
        s.load()
    Path(s.manifest_path).write_bytes(Path(s.manifest_path).read_bytes().replace(b"digest", b"digesT"))
    with pytest.raises(EngineError, match="corrupt"):
        s.load()


@pytest.mark.parametrize("boundary", BOUNDARIES)
def test_crash_at_each_boundary(spark, tmp_path, boundary):
    s = make(spark, tmp_path)
    s.commit(upserts=spark.createDataFrame([("one", [1.0, 0.0])], UP))

    def fault(at):
        if at == boundary:
            raise EngineError("crash")

    s.fault = fault
    with pytest.raises(EngineError, match="crash"):
        s.commit(upserts=spark.createDataFrame([("two", [1.0, 0.0])], UP))
    for _ in range(3):
        again = make(spark, tmp_path)
        done = boundary in BOUNDARIES[5:]
        assert ids(again) == (["one", "two"] if done else ["one"])
        assert again.manifest()["revision"] == (2 if done else 1)


@pytest.mark.parametrize("bad", ["", "a\nb", "x" * 65536])
def test_invalid_ids_and_vectors(spark, tmp_path, bad):
    s = make(spark, tmp_path)
    with pytest.raises(EngineError, match="invalidRecord"):
        s.commit(upserts=spark.createDataFrame([(bad, [1.0, 0.0])], UP))
    with pytest.raises(EngineError, match="invalidRecord"):
        s.commit(upserts=spark.createDataFrame([("a", [float("nan"), 0.0])], UP))
    half = make(spark, tmp_path, storage="float16")
    with pytest.raises(EngineError, match="invalidRecord"):
        half.commit(upserts=spark.createDataFrame([("a", [65520.0, 0.0])], UP))
    assert s.load() is None


def test_binary_bytes():
    data = binary_format.write([("id", np.array([1.0, 0.0]))], b"")
    assert data[:16] == bytes.fromhex("51454d42 02000000 0100000000000000")
    assert data[20:28] == bytes.fromhex("0200 6964 0000803f")
    bits = [binary_format.scalars(np.array([x]), "float16").view(np.uint16)[0] for x in (1, -2, 0.5, 65504)]
    assert bits == [0x3C00, 0xC000, 0x3800, 0x7BFF]
    for x in (65520, 70000, np.finfo(np.float32).max):
        with pytest.raises(EngineError, match="scalarOverflow"):
            binary_format.scalars(np.array([x]), "float16")
    assert np.allclose(binary_format.scalars(np.array([70000.0, 70000.0]), "float16", True), 2**-0.5, atol=1e-3)
    assert np.array_equal(binary_format.scalars(np.zeros(2), normalise=True), np.zeros(2))
    full = binary_format.write([("b", np.array([1.0, 2.0])), ("a", np.array([3.0, 4.0]))], b"{}")
    assert [i for i, _ in binary_format.read(full, 2)] == ["a", "b"]
    for cut in range(len(full)):
        with pytest.raises(EngineError):
            list(binary_format.read(full[:cut], 2))
    with pytest.raises(EngineError, match="incompatible"):
        list(binary_format.read(full, 2, metadata=b"[]"))


REF = coordinator.Reference("m", "i", "h", "g0")


def test_coordinator(tmp_path):
    c = coordinator.Coordinator(str(tmp_path))
    c.adopt(REF)
    first = c.request("m2", "i2", "h2")
    c = coordinator.Coordinator(str(tmp_path))
    assert c.state.phase == "paused"
    c.resume(first)
    c.cancel(first)
    c.resume(first)
    second = c.request("m2", "i2", "h2")
    with pytest.raises(EngineError, match="staleRequest"):
        c.activate(first, 1, True)
    for revision, complete, evidence in ((1, False, None), (0, True, None), (1, True, first)):
        with pytest.raises(EngineError, match="incompleteGeneration"):
            c.activate(second, revision, complete, evidence)
    c.activate(second, 1, True)
    assert (c.state.active, c.state.previous, c.state.phase) == (second, REF, "idle")
    c.rollback()
    assert (c.state.active, c.state.previous) == (REF, second)
    with pytest.raises(EngineError):
        c.adopt(REF)


def test_corrupt_coordinator_is_kept(tmp_path):
    coordinator.Coordinator(str(tmp_path)).adopt(REF)
    with pytest.raises(EngineError, match="invalidTransition"):
        coordinator.Coordinator.quarantine(str(tmp_path))
    path = tmp_path / "coordinator.json"
    damaged = path.read_bytes()[:-9]
    path.write_bytes(damaged)
    with pytest.raises(EngineError, match="corrupt"):
        coordinator.Coordinator(str(tmp_path))
    assert path.read_bytes() == damaged
    aside = coordinator.Coordinator.quarantine(str(tmp_path))
    assert aside.read_bytes() == damaged and coordinator.Coordinator(str(tmp_path)).state.phase == "idle"


def test_seal():
    assert durable.unseal(durable.seal({"a": [1]})) == {"a": [1]}


def test_identity_and_registry(tmp_path):
    assert spec.S4.identity == "7e54cbc768d58ae82c1e2c11e3347e489bffea88b6495fc020602101f17016fb"
    r = spec.Registry()
    r.register(spec.S2)
    with pytest.raises(EngineError, match="duplicateModel"):
        r.register(spec.S2)
    with pytest.raises(EngineError, match="missingArtifact"):
        r.register(spec.S4, str(tmp_path))
    for name in spec.S4.artifacts():
        (tmp_path / name).write_text(name)
    before = spec.S4.checkpoint_hash(str(tmp_path))
    (tmp_path / "vocab.json").write_text("other")
    assert spec.S4.checkpoint_hash(str(tmp_path)) != before


def test_a_batch_is_encoded_once(spark, tmp_path):
    """What was written is what was checked: the rows' function runs once a row."""
    import pandas as pd

    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<float>")
    def encode(ids: pd.Series) -> pd.Series:
        seen.add(len(ids))
        return pd.Series([[1.0, 2.0]] * len(ids))

    s = make(spark, tmp_path)
    s.commit(upserts=spark.createDataFrame([(f"i{k}",) for k in range(7)], "id string").select("id", encode("id").alias("embedding")))
    assert seen.value == 7 and len(ids(s)) == 7


def test_a_store_behind_a_path_that_only_spark_opens(spark, tmp_path):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.shop.link./in", f"file://{tmp_path}")
    s = VectorStore(spark, "viewfs://shop/in/store", "identity", "g1", 2)
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], UP)
    assert s.commit(upserts=rows) == 1 and s.commit(deletes=rows.where("id = 'a'").select("id")) == 2
    assert s.compact() == 3 and ids(s) == ["b"]
