import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.functions import ranking, text, tokenizer
from vecloom.operators import benchmarks, encoders, ordering, parity, store_log, sync
from vecloom.sources import generators
from vecloom.sources.store import VectorStore
from vecloom.streaming import sync as stream
from vecloom.types import EngineError


def test_generator_matches_the_published_values(spark):
    first = generators.block(0, 1, 4)[0]
    assert np.allclose(first, [-0.03697305917739868, 0.0027444958686828613, 0.3403778076171875, -0.1908448338508606], atol=0)
    assert np.array_equal(generators.block(3, 2, 5), generators.block(0, 5, 5)[3:])
    rows = generators.synthetic_vectors(spark, 10, 3, 4).orderBy("id").collect()
    assert len(rows) == 10 and np.array_equal(np.array(rows[4]["embedding"], np.float32), generators.block(4, 1, 3)[0])


def test_fixed_context(spark):
    vocabulary = {text.START: 11, text.STOP: 12, "a</w>": 7, text.PAD: 0}
    for c in (2, 4, 77):
        for w in (0, 1, c - 2, c, 200):
            df = spark.createDataFrame([("a " * w,)], "text string")
            body = tokenizer.encode_words(text.split_words(text.basic_clean(F.col("text"))), {})
            ids = df.select(tokenizer.lookup_ids(text.fixed_context(text.with_markers(body), c), vocabulary)).first()[0]
            n = min(w, c - 2)
            assert list(ids) == [11] + [7] * n + [12] + [0] * (c - n - 2)
    with pytest.raises(ValueError):
        text.fixed_context(F.col("x"), 1)
    with pytest.raises(EngineError, match="missingSpecialToken"):
        tokenizer.require_specials({})


def test_merges(spark):
    ranks = tokenizer.read_merges(["#v", "", "a b", "ab c</w>", "b c</w>"])
    assert tokenizer.encode_word("abc", ranks) == ["abc</w>"]
    assert tokenizer.encode_word("abab", ranks) == ["ab", "a", "b</w>"]
    assert tokenizer.encode_word("", ranks) == []
    for bad in (["a b c"], ["a"]):
        with pytest.raises(EngineError):
            tokenizer.read_merges(bad)


def test_spearman(spark):
    df = spark.createDataFrame([("same", float(i), float(i)) for i in range(5)] + [("back", float(i), float(-i)) for i in range(5)] + [("flat", 1.0, float(i)) for i in range(5)], "g string, a double, b double")
    got = {r["g"]: r["rank_correlation"] for r in ranking.spearman(df, "a", "b", ["g"]).collect()}
    assert abs(got["same"] - 1) < 1e-9 and abs(got["back"] + 1) < 1e-9 and got["flat"] is None


def test_parity_gate(spark):
    rows = [(str(i), "image" if i < 3 else "text", np.eye(6, dtype=np.float32)[i] + 0.1 * i) for i in range(6)]
    rows = [(i, k, (v / np.linalg.norm(v)).tolist()) for i, k, v in rows]
    ref = spark.createDataFrame(rows, "id string, kind string, vector array<float>")
    assert all(r["passed"] for r in parity.fixture_gate(ref, ref.select("id", "vector")).collect())
    off = ref.select("id", F.reverse("vector").alias("vector"))
    assert not any(r["passed"] for r in parity.fixture_gate(ref, off).collect())
    with pytest.raises(EngineError, match="candidateIDsMismatch"):
        parity.fixture_gate(ref, ref.select("id", "vector").where("id <> '1'"))
    with pytest.raises(EngineError, match="invalidFixtures"):
        parity.fixture_gate(ref.where("kind = 'text'"), ref.where("kind = 'text'").select("id", "vector"))


def test_cross_run_and_gate(spark):
    rows = [("m", run, float(scale * x)) for run, scale in enumerate((1, 2, 100)) for x in (1, 2, 3)]
    got = benchmarks.cross_run(spark.createDataFrame(rows, "metric string, run int, ms double")).first()
    assert got["median"] == 4 and got["p95"] == 300
    base = spark.createDataFrame([("a", 100.0), ("b", 100.0)], "metric string, median double")
    new = spark.createDataFrame([("a", 114.0), ("b", 116.0)], "metric string, median double")
    assert {r["metric"]: r["regression"] for r in benchmarks.compare(base, new, 15).collect()} == {"a": False, "b": True}
    for bad in ({"runs": 0}, {"samples": 2}, {"sizes": (5, 5)}, {"k": 1001}):
        with pytest.raises(EngineError):
            benchmarks.workload(**bad)


def test_encoding_falls_back(spark):
    good = encoders.digest_encoder(4)

    def picky(texts):
        if len(texts) > 1 or texts[0] == "bad":
            raise ValueError
        return good(texts)

    assert [v is None for v in encoders.encode_batch(["a", "bad", "b"], picky, 4)] == [False, True, False]
    short = lambda texts: good(texts)[:1]
    assert [v is None for v in encoders.encode_batch(["a", "b"], short, 4)] == [False, False]
    zero = lambda texts: [np.zeros(4)] * len(texts)
    assert encoders.encode_batch(["a"], zero, 4) == [None]
    rows = spark.createDataFrame([(1, "x"), (2, None)], "id long, item string")
    assert encoders.encode(rows, lambda: encoders.digest_encoder(4), 4).where("failed").count() == 0


def test_access_level(spark):
    index = spark.createDataFrame([("visible", [1.0]), ("hidden", [1.0]), ("blank", [0.0])], "id string, embedding array<float>")
    library = spark.createDataFrame([("visible",), ("blank",), ("new",)], "id string")
    assert sync.deletions(library, index, "limited").count() == 0
    assert [r["id"] for r in sync.deletions(library, index, "full").collect()] == ["hidden"]
    assert sorted(r["id"] for r in sync.additions(library, index, 1).collect()) == ["blank", "new"]
    assert sync.progress(library, index, 1).first().asDict() == {"required": 3, "indexed": 1, "blank": 1, "remaining": 2}


def test_replay_order(spark):
    one = spark.createDataFrame([("a", [1.0]), ("b", [1.0])], "id string, embedding array<float>")
    two = spark.createDataFrame([("a", [2.0])], "id string, embedding array<float>")
    log = store_log.segment_ops(0, one).unionByName(store_log.segment_ops(1, two, one.select("id")))
    assert [(r["id"], r["embedding"]) for r in store_log.replay(log).collect()] == [("a", [2.0])]


def test_positions(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v")).repartition(5)
    got = ordering.positions(df, ["v"]).collect()
    assert sorted((r["v"], r["position"]) for r in got) == [(i, i) for i in range(1000)]


def test_stream_batches_apply_once(spark, tmp_path):
    s = VectorStore(spark, str(tmp_path / "store"), "identity", "g1", 1, normalization="none")
    encode = lambda df: df.select("id", F.array(F.lit(1.0).cast("float")).alias("embedding"))
    batch = spark.createDataFrame([("a", 1, "U"), ("b", 2, "U"), ("a", 3, "D")], "id string, seq long, op string")
    assert stream.apply_batch(s, batch, 0, encode)
    assert not stream.apply_batch(s, batch, 0, encode)
    assert [r["id"] for r in s.load()[0].collect()] == ["b"] and s.manifest()["revision"] == 1


def test_every_query_has_stable_columns(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["rank", "id", "score"]


def test_token_match_sees_damage(spark, monkeypatch):
    from vecloom.plans import catalogue

    d = "/root/testdata/sf0.001"
    assert {r["same"] for r in catalogue.token_exact_match(spark, d).collect()} == {True}
    whole = tokenizer.encode_words
    monkeypatch.setattr(tokenizer, "encode_words", lambda w, ranks: F.slice(whole(w, ranks), 2, 1_000_000))
    assert {r["same"] for r in catalogue.token_exact_match(spark, d).collect()} == {False}
