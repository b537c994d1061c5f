import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.llm import embedding_dedup, minhash_dedup
from vecloom.llm.components import components
from vecloom.runtime import Scratch


def bag(t):
    w = re.findall(r"[a-z0-9_\u0080-\U0010ffff]+", (t or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1 if w else 0)))


def brute_classes(rows, threshold=0.8):
    bags = [bag(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both, either = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
            if either and both >= threshold * either - 1e-12:
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, k), k)
    return sorted((k, least[find(i)]) for i, (k, _) in enumerate(rows))


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([8, 40, 150]))]
        for _ in range(rng.choice([1, 2, 25])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 3, 12])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows) * 3, " ".join(copy)))
    rows += [(9000, None), (9001, ""), (9002, "?!"), (9003, "one two"), (9004, "One, two!"), (9004, "One, two!"), (9005, "la " * 300), (9006, "la " * 250), (9007, "la " * 200)]
    return rows


@pytest.mark.parametrize("small, rows, units, columns", [(64, 1024, 400_000, 2048), (2, 5, 300, 64)])
def test_classes_against_brute_force(spark, monkeypatch, small, rows, units, columns):
    monkeypatch.setattr(minhash_dedup, "SMALL_BUCKET", small)
    monkeypatch.setattr(minhash_dedup, "CHUNK_ROWS", rows)
    monkeypatch.setattr(minhash_dedup, "CHUNK_UNITS", units)
    monkeypatch.setattr(minhash_dedup, "SLICE", columns)
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string").repartition(3)
    got = minhash_dedup.near_classes(df).collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in got) == brute_classes(rows)
    left = minhash_dedup.drop_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted({c for _, c in brute_classes(rows)})


def test_near_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert minhash_dedup.near_classes(df).count() == 0 and minhash_dedup.drop_near_duplicates(df).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    rows, digests, weights = [], [], []
    for r in range(2):
        rows.append(np.full(300, r))
        digests.append(np.arange(300, dtype=np.uint64) + np.uint64(60 * r))
        weights.append(rng.integers(1, 9, 300))
    a, b = [(np.sort(minhash_dedup.mix(d)), w[np.argsort(minhash_dedup.mix(d))]) for d, w in zip(digests, weights)]
    sig = minhash_dedup.signatures(2, np.concatenate(rows), minhash_dedup.mix(np.concatenate(digests)), np.concatenate(weights), 1 << 13)
    assert abs((sig[0] == sig[1]).mean() - minhash_dedup.similarity(a, b)) < 0.025


def brute_links(rows, threshold=0.95):
    ok = lambda v: v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
    n = [0] * len(rows)
    root = list(range(len(rows)))
    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if ok(a) and ok(b) and len(a) == len(b):
                x, y = np.array(a, np.float64), np.array(b, np.float64)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    n[i] += 1
                    n[j] += 1
                    p, q = root[i], root[j]
                    root = [q if r == p else r for r in root]
    least = {}
    for i, (k, _) in enumerate(rows):
        least[root[i]] = min(least.get(root[i], k), k)
    return sorted((k, n[i], least[root[i]], k == least[root[i]]) for i, (k, _) in enumerate(rows))


@pytest.mark.parametrize(("size", "slab"), [(256, 7), (2 << 20, 1 << 23)])
def test_vectors_against_brute_force(spark, monkeypatch, size, slab):
    monkeypatch.setattr(embedding_dedup, "TILE_BYTES", size)
    monkeypatch.setattr(embedding_dedup, "SLAB", slab)
    rng = np.random.default_rng(2)
    rows = []
    for g in range(25):
        base = rng.standard_normal(12)
        for _ in range(rng.choice([1, 2, 14])):
            v = base + rng.standard_normal(12) * rng.choice([0, 0.05, 0.2])
            rows.append((len(rows) * 7 + 3, (v * rng.choice([1e-3, 1, 50])).astype(np.float32).tolist()))
    rows += [(1, None), (2, []), (4, [0.0] * 12), (5, [float("nan")] + [1.0] * 11), (6, [float("inf")] * 12), (8, [1.0, None] + [1.0] * 10), (9, [1.0, 2.0]), (11, [2.0, 4.0]), (12, rows[0][1]), (12, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, row int").repartition(3)
    assert sorted(tuple(r) for r in embedding_dedup.near_vectors(df).collect()) == brute_links(rows)
    assert embedding_dedup.near_vectors(df.where("vec_id < 0")).count() == 0


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000, 1000 + i) for i in range(50)] + [(2000 + i, 2001 + i) for i in range(60)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    got = components(spark.createDataFrame(pairs, "src long, dst long"), Scratch(spark, "test")).collect()
    assert {r["node"]: r["component"] for r in got} == {x: find(x) for x in root}


def test_bounds_hold_at_the_threshold():
    """Sure and doubtful pairs together are all pairs at the threshold or above, and the sure ones are."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal((6, 32))
    x = embedding_dedup.unit(np.repeat(base, 20, 0) + rng.standard_normal((120, 32)) * 0.22)
    sure, doubt = embedding_dedup.compare(embedding_dedup.quantise(x), None, 0.95)
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.95, 1)))}
    assert set(zip(*sure)) <= want <= set(zip(*sure)) | set(zip(*doubt)) and len(doubt[0]) > 20
    assert set(zip(*sure)) | set(zip(*embedding_dedup.exactly(x, None, 0.95))) == want


def test_near_duplicates_keep_odd_columns_and_one_of_each_row(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [("b", text, 1, 5), ("a", text, 2, 6), ("a", text, 3, 7), (None, text, 4, 8), ("c", "other words stand in this one here", 5, 9), ("d", "", 6, 1), ("d", "", 7, 2), (None, None, 8, 3)]
    df = spark.createDataFrame(rows, "doc_id string, text string, __node long, NODE long")
    left = minhash_dedup.drop_near_duplicates(df)
    got = sorted(left.collect(), key=lambda r: r["__node"])
    assert left.columns == df.columns and left.dtypes == df.dtypes
    assert [(r["doc_id"], r["__node"], r["NODE"]) for r in got] == [("a", 2, 6), ("c", 5, 9), ("d", 6, 1), ("d", 7, 2), (None, 8, 3)]
    assert Counter(r["class_id"] for r in minhash_dedup.near_classes(df).collect()) == {None: 1, "a": 4, "c": 1, "d": 2}


def test_joins_of_hot_buckets(spark, monkeypatch):
    rows = spark.range(500).select((F.col("id") % 3).alias("bucket"), F.col("id").alias("node"))
    small = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    want = sorted(map(tuple, rows.join(small, "bucket").collect()))
    for k, most in enumerate((50_000, 1)):
        monkeypatch.setattr(minhash_dedup, "LARGEST_BROADCAST", most)
        assert sorted(map(tuple, minhash_dedup._joined(rows, small, Scratch(spark, "test"), f"s{k}").select("bucket", "node", "n").collect())) == want


def test_recall_just_above_the_threshold():
    """Pairs of similarity 0.8 to 0.82: all share a band, and all pass the agreement that small buckets ask for."""
    rng = np.random.default_rng(9)
    row, digest, pairs = [], [], 400
    for p in range(pairs):
        own = minhash_dedup.mix(rng.integers(1, 1 << 62, 220).astype(np.uint64))
        for k in (0, 1):
            row.append(np.full(200, 2 * p + k))
            digest.append(own[20 * k : 200 + 20 * k])
    sig = minhash_dedup.signatures(2 * pairs, np.concatenate(row), np.concatenate(digest), np.ones(400 * pairs, np.int64))
    bands = minhash_dedup.bands(sig)
    found = [(bands[2 * p] == bands[2 * p + 1]).any() and (sig[2 * p] == sig[2 * p + 1]).mean() >= minhash_dedup.LEAST_AGREEMENT for p in range(pairs)]
    assert np.mean(found) >= 0.999
