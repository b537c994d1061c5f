import pytest
from pyspark.sql import functions as F

from vecloom.operators import benchmarks, library
from vecloom.sources.store import VectorStore
from vecloom.types import EngineError

LOG = "seq long, op string, album string, id long"


def run(spark, log, existing=(("a", 1), ("a", 2)), albums=("a",)):
    found = library.members(spark.createDataFrame(list(existing), "album string, id long"), spark.createDataFrame([(x,) for x in albums], "album string"), spark.createDataFrame(log, LOG))
    return sorted(map(tuple, found.collect()))


def test_last_change_decides(spark):
    assert run(spark, []) == [("a", 1), ("a", 2)]
    assert run(spark, [(1, "remove", "a", 1), (2, "add", "a", 1), (3, "remove", "a", 2)]) == [("a", 1)]
    assert run(spark, [(1, "removeAll", "a", None), (2, "add", "a", 3)]) == [("a", 3)]
    assert run(spark, [(1, "create", "b", None), (2, "add", "b", 1), (3, "delete", None, 1)]) == [("a", 2)]
    assert run(spark, [(1, "delete", None, 1), (2, "add", "a", 1)]) == [("a", 1), ("a", 2)]
    assert run(spark, [(1, None, "a", 1), (2, "add", "a", None), (3, "add", None, 9), (4, "delete", None, None)]) == [("a", 1), ("a", 2)]


def test_unknown_album_fails(spark):
    with pytest.raises(EngineError) as e:
        run(spark, [(1, "add", "b", 1)])
    assert e.value.code == "missingAssetCollection"


def test_repeated_rows_and_empty_tables(spark):
    assert run(spark, [(1, "add", "a", 5)] * 3, existing=[("a", 1)] * 2) == [("a", 1), ("a", 5)]
    assert run(spark, [], existing=[]) == []


def test_favourites(spark):
    items = spark.createDataFrame([(1, None), (2, True), (3, False)], "id long, favourite boolean")
    log = spark.createDataFrame([(1, "favour", None, 1), (2, "unfavour", None, 1), (3, "favour", None, 1), (4, "delete", None, 3), (5, "favour", None, 9)], LOG)
    assert sorted(map(tuple, library.favourites(items, log).collect())) == [(1, True), (2, True)]


def test_policies(spark):
    names = {"iPhone11,8": True, "iPhone12,1": False, "iPad11,1": True, "iPad13,4": False, "iPhone,1": False, "iPhoneX,1": False, "Mac1,1": False, "iPhone11": False, "iPhone1,2,3": False, "iPhone99999999999999999999,1": False, None: False, "": False}
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", library.cpu_only(F.col("n")).alias("c")).collect()
    assert {r["n"]: r["c"] for r in rows} == names
    cases = {(False, "nominal"): False, (True, "nominal"): True, (False, "serious"): True, (False, "critical"): True, (None, None): False, (None, "fair"): False}
    rows = spark.createDataFrame(list(cases), "l boolean, h string").select("l", "h", library.paused(F.col("l"), F.col("h")).alias("p")).collect()
    assert {(r["l"], r["h"]): r["p"] for r in rows} == cases


def test_fingerprint_tells_names_and_contents(spark):
    def of(*files):
        return benchmarks.source_fingerprint(spark.createDataFrame([(n, bytearray(c)) for n, c in files], "name string, content binary")).first()[0]

    a = of(("a.py", b"1"), ("b.py", b"2"))
    assert a == of(("b.py", b"2"), ("a.py", b"1"))
    assert len({a, of(("a.py", b"2"), ("b.py", b"1")), of(("a.py", b"1")), of()}) == 4


def test_load_or_none(spark, tmp_path):
    s = VectorStore(spark, str(tmp_path), "m", "g1", 2)
    assert s.load_or_none() is None
    s.commit(upserts=spark.createDataFrame([("x", [1.0, 0.0])], "id string, embedding array<float>"))
    assert s.load_or_none().count() == 1
    assert VectorStore(spark, str(tmp_path), "other", "g1", 2).load_or_none() is None
