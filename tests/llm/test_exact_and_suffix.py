import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.llm import exact_dedup, suffix_dedup
from vecloom.types import EngineError

DOCS = "doc_id long, text string, lang string, keep_id string"


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        first = True
        for i in sorted(ids, key=lambda x: (x is None, x)):
            out.append((i, keep, len(ids), i == keep and first, hashlib.sha256(t.encode()).hexdigest()))
            first = first and i != keep
    return out


def test_exact_groups(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LEAST_ROWS", 3)
    rows = [(i, "hot  text\n") for i in range(40)] + [(100 + i, f"t{i // 2}\t x") for i in range(30)]
    rows += [(200, None), (201, ""), (202, " "), (203, "\n\t "), (5, "hot text "), (5, "hot text "), (None, "t0 x"), (300, "nb sp"), (301, "nb sp"), (302, "z" * 200000)]
    df = spark.createDataFrame([(i, t, "en", "odd") for i, t in rows], DOCS).repartition(5)
    got = [tuple(r) for r in exact_dedup.exact_groups(df).collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(brute_exact(rows), key=key)
    kept = exact_dedup.drop_duplicates_exact(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in brute_exact(rows) if r[3])


def test_hot_texts_that_share_ids(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LEAST_ROWS", 3)
    rows = [(None, t) for t in ("hot a", "hot b") for _ in range(5)]  # no id at all: one salt for both
    rows += [(i, t) for t in ("hot c", "hot d") for i in (7, 7, 7, *range(8, 20))] + [(None, "hot d")]
    df = spark.createDataFrame([(i, t, "en", "odd") for i, t in rows], DOCS).repartition(3)
    key = lambda r: tuple((x is None, x) for x in r)
    got = [tuple(r) for r in exact_dedup.exact_groups(df).collect()]
    assert sorted(got, key=key) == sorted(brute_exact(rows), key=key)
    assert sorted(r["text"] for r in exact_dedup.drop_duplicates_exact(df).collect()) == ["hot a", "hot b", "hot c", "hot d"]


def test_exact_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_groups(df).count() == 0 and exact_dedup.drop_duplicates_exact(df).count() == 0


def brute_spans(rows, length=50):
    first = {}
    for i, t in rows:
        for k in range(len(t) - length + 1):
            s = t[k : k + length]
            first[s] = min(first.get(s, i), i)
    out = {}
    for i, t in rows:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.setdefault(i, []).append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return {i: sorted(v) for i, v in out.items()}


@pytest.mark.parametrize(("hot", "bucket"), [(4096, 2 << 20), (1, 500), (2, 2 << 20)])
def test_spans_against_brute_force(spark, monkeypatch, hot, bucket):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", bucket)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abé ") for _ in range(rng.randint(1, 9)))
    passages = ["".join(word() for _ in range(30)) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [rng.choice(passages)[rng.randint(0, 30) : rng.randint(40, 120)] if rng.random() < 0.4 else "".join(word() for _ in range(12)) for _ in range(4)]
        rows.append((i, "".join(parts)))
    rows += [(500, "a" * 400), (501, "b" * 20 + "a" * 90), (502, "xy" * 100), (503, "yx" * 60), (504, None), (505, ""), (506, "q" * 49), (507, "q" * 50), (507, "q" * 50), (508, "q" * 51), (None, "a" * 60)]
    rows += [(600 + i, "copy of a text " * 9) for i in range(5)] + [(600, "copy of a text " * 9), (None, "copy of a text " * 9), (None, "z" * 70), (None, "z" * 70), (700, "short one"), (701, "short one")]
    df = spark.createDataFrame([(i, t, "en", None) for i, t in rows], DOCS).repartition(4)
    last = suffix_dedup.LAST
    want = brute_spans([(last if i is None else i, (t or "").encode()) for i, t in rows])
    got = {}
    for r in suffix_dedup.removed_spans(df).collect():
        got.setdefault(last if r[0] is None else r[0], []).append(tuple(r)[1:])
    assert {i: sorted(v) for i, v in got.items()} == want
    cut = suffix_dedup.remove_repeats(df)
    assert cut.columns == df.columns
    assert cut.where("text IS NULL").count() == 1 and cut.where("doc_id = 508").first()["text"] == ""
    assert cut.count() == len(rows)


def test_spans_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.removed_spans(df).count() == 0
    assert suffix_dedup.removed_spans(df.unionAll(spark.createDataFrame([(1, None)], df.schema))).first()["n_bytes"] == 0


def test_long_text(spark):
    df = spark.createDataFrame([(1, "abc def " * 60000), (2, "abc def " * 60000 + "tail")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.removed_spans(df).collect()}
    assert got == {1: 0, 2: 480000}
    assert exact_dedup.exact_groups(df).where(F.col("kept")).count() == 2


def test_ids_must_be_numbers(spark):
    df = spark.createDataFrame([("a", "x" * 60)], "doc_id string, text string")
    with pytest.raises(EngineError, match="unsupportedID"):
        suffix_dedup.removed_spans(df)


@pytest.mark.parametrize("letters", ["ab", "a", "abcdefgh"])
def test_bucket_pointers(letters):
    """Pointers at depth 50 are equal for equal strings only; runs end where their text does."""
    rng = random.Random(len(letters))
    base = ["".join(rng.choice(letters) for _ in range(120)) for _ in range(3)]
    runs = []
    for _ in range(60):
        a = rng.randint(0, 60)
        run = rng.choice(base)[a : a + rng.randint(1, 81)]
        runs.append(run if rng.random() < 0.5 else run[:30] + rng.choice(letters) + run[31:])
    buf = np.frombuffer("".join(runs).encode(), np.uint8)
    left = np.concatenate([np.arange(len(r), 0, -1) for r in runs])
    pointer = suffix_dedup.classes(buf, left)
    text, of = "".join(runs), {}
    for p in np.flatnonzero(left >= 50):
        of.setdefault(text[p : p + 50], set()).add(int(pointer[p]))
    assert all(len(v) == 1 for v in of.values())
    assert len({next(iter(v)) for v in of.values()}) == len(of)
    assert len(suffix_dedup.classes(np.zeros(0, np.uint8), np.zeros(0, int))) == 0


def test_equal_digests_are_compared_by_bytes(monkeypatch):
    """With a digest that says nothing, runs of other bytes still are other records."""
    texts = [bytes(random.Random(k).choices(b"abc", k=70)) for k in (1, 2, 1)]
    block = suffix_dedup.Block(texts, np.array([5, 6, 7]), True)
    shared = np.unique(block.key)
    runs, record, source, least = block.records(shared)
    whole = [block.buf[block.start[r] : block.start[r] + block.size[r] + 49].tobytes() for r in runs]
    monkeypatch.setattr(suffix_dedup, "mix", lambda x: x * np.uint64(0))
    _, blind, source2, least2 = block.records(shared)
    for rec, src, low in ((record, source, least), (blind, source2, least2)):
        for k, w in zip(rec, whole):
            s = src[k]
            assert block.buf[block.start[s] : block.start[s] + block.size[s] + 49].tobytes() == w
        for k in range(len(src)):
            assert low[k] == block.doc[runs[rec == k]].min()
    assert len(source) == len(set(whole)) <= len(source2)


def test_hot_text_without_ids_and_odd_columns(spark):
    rows = [(None, "same text", k, k) for k in range(90)] + [(7, "same  text", 90, 90), (1, "other", 91, 91)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __row int, row int").repartition(5)
    got = exact_dedup.exact_groups(df).collect()
    assert sum(r["kept"] for r in got) == 2 and {(r["keep_id"], r["group_size"]) for r in got} == {(7, 91), (1, 1)}
    left = exact_dedup.drop_duplicates_exact(df)
    assert left.columns == df.columns and sorted(r["__row"] for r in left.collect()) == [90, 91]
