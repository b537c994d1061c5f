import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.functions import vector
from vecloom.operators import packed, search
from vecloom.types import EngineError


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, embedding array<float>")


def test_known_cosines(spark):
    rows = frame(spark, [("same", [3.0, 0.0]), ("diagonal", [1.0, 1.0]), ("orthogonal", [0.0, 2.0]), ("opposite", [-4.0, 0.0])])
    got = search.search(search.VectorIndex.publish(rows, 2), [1.0, 0.0]).collect()
    assert [r["id"] for r in got] == ["same", "diagonal", "orthogonal", "opposite"]
    assert np.allclose([r["score"] for r in got], [1, math.sqrt(0.5), 0, -1], atol=1e-6)


def test_ties_go_by_id_and_item_is_in_its_own_results(spark):
    rows = frame(spark, [("c", [0.0, 1.0]), ("a", [1.0, 0.0]), ("b", [1.0, 1.0])])
    index = search.VectorIndex.publish(rows, 2)
    assert [r["id"] for r in search.similar(index, "b").collect()] == ["b", "a", "c"]
    assert [r["id"] for r in search.search(index, [1.0, 0.0], 2).collect()] == ["a", "b"]
    with pytest.raises(EngineError, match="referencePhotoMissing"):
        search.similar(index, "zz")


def test_large_finite_vectors(spark):
    big = float(np.finfo(np.float32).max)
    index = search.VectorIndex.publish(frame(spark, [("x", [big, big])]), 2)
    assert abs(search.search(index, [big, big]).first()["score"] - 1) < 1e-6


@pytest.mark.parametrize(
    "bad, code",
    [([1.0], "dimensionMismatch"), ([0.0, 0.0], "zeroNormVector"), ([1e-20, 0.0], "zeroNormVector"), ([1.0, float("nan")], "nonFiniteVector"), ([1.0, float("inf")], "nonFiniteVector")],
)
def test_one_invalid_row_or_query_fails_all(spark, bad, code):
    with pytest.raises(EngineError) as e:
        search.VectorIndex.publish(frame(spark, [("good", [1.0, 0.0]), ("bad", bad)]), 2)
    assert e.value.code == code
    empty = search.VectorIndex.publish(frame(spark, []), 2)
    with pytest.raises(EngineError) as e:
        search.search(empty, bad)
    assert e.value.code == code


def test_filters_before_the_limit(spark):
    rows = frame(spark, [("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0])])
    index = search.VectorIndex.publish(rows, 2)
    visible = spark.createDataFrame([("c",), ("b",)], "id string")
    assert [r["id"] for r in search.search(index, [1.0, 0.0], 1, visible).collect()] == ["b"]
    assert search.search(index, [1.0, 0.0], -3).count() == 0


def test_half_precision_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.standard_normal(500), 2.0 ** rng.integers(-26, 16, 200), [0, -0.0, 1, -2, 0.5, 65504, 65519, 2**-24, 2**-25, 6e-8, 1 + 2**-11, 1 + 3 * 2**-11]]).astype(np.float32)
    df = spark.createDataFrame([(float(v),) for v in x], "x float").coalesce(1)
    got = [r[0] for r in df.select(vector.half(F.col("x"))).collect()]
    assert np.array_equal(np.array(got), x.astype(np.float16).astype(np.float64))
    assert spark.range(1).select(vector.half(F.lit(65520.0)), vector.half(F.lit(-70000.0))).first()[:] == (None, None)


def test_backends_agree(spark):
    rng = np.random.default_rng(0)
    rows = frame(spark, [(f"i{k:03}", v.tolist()) for k, v in enumerate(rng.standard_normal((300, 16)).astype(np.float32))])
    index = search.VectorIndex.publish(rows, 16)
    q = rng.standard_normal(16).astype(np.float32).tolist()
    exact = {r["id"]: r["score"] for r in search.score(index, q).collect()}
    half = {r["id"]: r["score"] for r in search.score_half(index, q).collect()}
    assert max(abs(exact[i] - half[i]) for i in exact) < 2e-3
    blocks = search.score_blocks(index, {"q": q}, 5).orderBy(F.col("score").desc(), "id").limit(5).collect()
    assert [r["id"] for r in blocks] == [r["id"] for r in search.search(index, q, 5).collect()]


def test_backend_errors(spark):
    index = search.VectorIndex.publish(frame(spark, [("a", [1.0, 0.0])]), 2)

    def broken(code):
        def f(*_):
            raise EngineError(code)

        return f

    assert search.search(index, [1.0, 0.0], backend="arrow", scorer=broken("resultsUnavailable")).count() == 1
    with pytest.raises(EngineError, match="zeroNormVector"):
        search.search(index, [1.0, 0.0], backend="arrow", scorer=broken("zeroNormVector"))


def test_packed_index(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((500, 32)).astype(np.float32)
    rows = frame(spark, [(f"i{k:03}", v.tolist()) for k, v in enumerate(x)]).repartition(3)
    index = packed.PackedIndex.build(rows, 32)
    exact = search.VectorIndex.publish(rows, 32)
    got = index.search({"a": x[0].tolist(), "b": x[1].tolist()}, 5)
    for name, k in (("a", 0), ("b", 1)):
        want = search.search(exact, x[k].tolist(), 5).collect()
        have = got.where(F.col("query_id") == name).orderBy("rank").collect()
        assert [r["id"] for r in have] == [r["id"] for r in want]
        assert max(abs(a["score"] - b["score"]) for a, b in zip(have, want)) < 2e-3
    assert index.search({"a": x[0].tolist()}, -1).count() == 0
    index.release()
    for bad, code in (([1.0], "dimensionMismatch"), ([0.0] * 32, "zeroNormVector"), ([float("nan")] * 32, "nonFiniteVector")):
        with pytest.raises(EngineError) as e:
            packed.PackedIndex.build(rows.unionAll(frame(spark, [("bad", bad)])), 32)
        assert e.value.code == code
    assert packed.PackedIndex.build(frame(spark, []), 32).search({"a": x[0].tolist()}, 5).count() == 0


def test_updates_of_the_packed_index(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((40, 8)).astype(np.float32)
    old = packed.PackedIndex.build(frame(spark, [(f"i{k:02}", v.tolist()) for k, v in enumerate(x)]).repartition(3), 8)
    held = lambda index: {r["id"]: r["score"] for r in index.search({"q": x[0].tolist()}, 100).collect()}
    first = held(old)
    new = old.upsert(frame(spark, [("i01", x[0].tolist()), ("new", x[0].tolist())]))
    assert set(held(new)) == {*first, "new"} and abs(held(new)["i01"] - 1) < 2e-3 and held(old) == first
    less = new.remove(frame(spark, [("i01", None), ("unknown", None)]).select("id"))
    assert set(held(less)) == {*first, "new"} - {"i01"}
    assert held(less.remove(less.blocks.selectExpr("explode(ids) AS id"))) == {}
    for bad, code in (([("a", x[0].tolist()), ("a", x[1].tolist())], "duplicateID"), ([("a", [0.0] * 8)], "zeroNormVector"), ([("a", [1.0])], "dimensionMismatch")):
        with pytest.raises(EngineError, match=code):
            old.upsert(frame(spark, bad))
    assert held(old) == first


def test_invalid_rows_fail_item_queries(spark):
    good = [("a", [1.0, 0.0]), ("b", [0.0, 1.0])]
    for bad, code in (([float("nan"), 1.0], "nonFiniteVector"), ([1.0], "dimensionMismatch"), ([0.0, 0.0], "zeroNormVector"), (None, "dimensionMismatch")):
        rows = frame(spark, [*good, ("c", bad)])
        with pytest.raises(EngineError, match=code):
            search.item_query(rows, "a", 2, visible=frame(spark, good).select("id"))
        for pair in ((rows, frame(spark, good)), (frame(spark, good), rows)):
            with pytest.raises(EngineError, match=code):
                search.batch_top(pair[0], pair[1].withColumnRenamed("id", "query_id"), 2, 2)
    with pytest.raises(EngineError, match="referencePhotoMissing"):
        search.item_query(frame(spark, good), "z", 2)
    assert [r["id"] for r in search.item_query(frame(spark, good), "b", 2).collect()] == ["b", "a"]


def test_many_queries_at_once(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((90, 8)).astype(np.float32)
    rows = frame(spark, [(f"i{k:02}", v.tolist()) for k, v in enumerate([*x, x[0], x[0]])]).repartition(4)
    asked = rows.limit(30).withColumnRenamed("id", "query_id")
    want = None
    for most in (10_000, 3):
        monkeypatch.setattr(search, "LARGEST_BROADCAST", most)
        monkeypatch.setattr(search, "QUERY_BLOCK", 7)
        got = sorted(map(tuple, search.batch_top(rows, asked, 4, 8).collect()))
        assert want is None or got == want
        want = got
    index = search.VectorIndex.publish(rows, 8)
    name = want[0][0]
    assert [(r, i) for q, r, i, _ in want if q == name] == [(r["rank"], r["id"]) for r in search.similar(index, name, 4).collect()]
    assert search.batch_top(rows, asked, -1, 8).count() == 0


def test_parity_of_bad_pairs(spark):
    from vecloom.operators import parity

    one, off = [1.0, 0.0], [1.005, 0.0]
    rows = [("zero", one, [0.0, 0.0]), ("short", one, [1.0]), ("null", one, None), ("nan", one, [float("nan"), 0.0]), ("loose", off, one), ("good", one, one)]
    df = spark.createDataFrame([(i, "image", a, b) for i, a, b in rows], "id string, kind string, reference array<float>, candidate array<float>")
    got = {r["id"]: r["failures"] for r in parity.pair_gate(df, "fp16").collect()}
    assert all("vector-validation" in got[i] for i in ("zero", "short", "null", "nan", "loose")) and got["good"] == []
